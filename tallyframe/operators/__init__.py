"""Operators: DataFrames and `Params` in, DataFrame out. None of them runs an action."""
