"""Semantic-cache analytics on Spark DataFrames."""
