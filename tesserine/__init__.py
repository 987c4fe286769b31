"""Spatial-graph analytics on Spark DataFrames."""
