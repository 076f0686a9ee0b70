"""Spatial-semantic relational operators on Spark DataFrames."""
