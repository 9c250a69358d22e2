"""Reusable operators, from DataFrames to DataFrames."""
