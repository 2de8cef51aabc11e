"""Operators of a large-scale training-data pipeline, each on Spark DataFrames."""
