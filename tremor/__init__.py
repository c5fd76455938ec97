"""Spark-native analytics over point-event catalogues and hourly series."""
