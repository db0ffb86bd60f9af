"""Operators on pixels and tiles (DataFrame in, DataFrame out)."""
