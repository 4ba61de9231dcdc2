"""Operators over library tables: each is a function from DataFrames to DataFrames."""
