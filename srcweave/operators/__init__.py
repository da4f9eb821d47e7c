"""Operators over the fact tables: DataFrames in, DataFrames out."""
