"""Relational operators: DataFrames in, DataFrame out, nothing is run."""
