"""Operators: DataFrames in, DataFrame out, nothing collected on the way."""
