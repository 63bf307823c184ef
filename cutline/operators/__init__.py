"""Relational and domain operators over DataFrames; table and column names are parameters."""
