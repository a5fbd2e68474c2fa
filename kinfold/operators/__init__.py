"""Relational and similarity operators: pure functions from DataFrames to DataFrames."""
