"""Operators for large text and vector collections used as training data."""
