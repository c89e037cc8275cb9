"""Operators on DataFrames; each returns a lazy DataFrame."""
