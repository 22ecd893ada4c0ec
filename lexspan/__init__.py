"""Governed document retrieval analytics on Spark DataFrames."""
