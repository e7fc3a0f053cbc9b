"""Pairwise sequence comparison on Spark: DataFrames of sequences in, DataFrames out."""
