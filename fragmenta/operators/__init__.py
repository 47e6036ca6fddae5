"""Relational operators: intervals, windows, documents, vectors, fusion, ranking."""
