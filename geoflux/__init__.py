"""Geospatial analytics on ordinary Spark DataFrames."""
