"""Scalar helpers as Column expressions."""
