"""Operators for building training corpora, each on Spark DataFrames."""
