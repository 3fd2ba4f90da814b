"""Retrieval, fact-history and evaluation analytics on Spark DataFrames."""
