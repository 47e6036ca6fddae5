"""Scalar text functions as Column expressions."""
