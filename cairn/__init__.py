"""Geospatial, graph and trajectory analytics on Spark DataFrames."""
