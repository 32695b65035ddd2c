"""Dumps as they arrive."""
