"""Tiled raster and terrain analytics on Spark DataFrames."""
