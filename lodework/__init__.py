"""Hybrid retrieval and training-data processing on Spark DataFrames."""
