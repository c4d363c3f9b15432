"""Operators for large-scale training-data pipelines (self-contained; nothing else in the library imports this)."""
