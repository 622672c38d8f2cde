"""Retrieval and knowledge analytics on Spark DataFrames."""
