"""Queries over dumps, heaps and terms."""
