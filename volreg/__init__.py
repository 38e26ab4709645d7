"""Volumetric land registers as Spark DataFrames."""
