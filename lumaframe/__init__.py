"""Raster value analytics on PySpark."""
