"""Operators: DataFrames in, DataFrames out; none changes its input."""
