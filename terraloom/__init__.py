"""Terraloom: raster, height and event analytics as Spark DataFrame plans."""
