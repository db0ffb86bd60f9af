"""Readers and writers of raster files and tables."""
