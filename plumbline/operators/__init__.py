"""Operators: DataFrames in, DataFrames out, columns named by the caller."""
