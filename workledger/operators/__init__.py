"""Projections: DataFrames in, DataFrames out."""
