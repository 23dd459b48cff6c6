"""Operators: DataFrames in, DataFrame out; columns and limits are arguments."""
