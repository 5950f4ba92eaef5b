"""Spark-native analytics for field, weather, raster and route data."""
