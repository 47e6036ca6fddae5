"""Whole queries built from the operators, and the SQL they are checked against."""
