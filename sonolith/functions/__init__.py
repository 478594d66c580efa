"""Numeric column functions with stated edge behaviour."""
