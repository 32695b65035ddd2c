"""Operators for large-scale training-data preparation; nothing else in cairn imports this subpackage."""
