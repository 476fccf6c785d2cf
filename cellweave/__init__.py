"""Spatial and tabular analytics on Spark DataFrames."""
