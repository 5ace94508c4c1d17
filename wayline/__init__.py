"""Spark-native mobility and geospatial analytics."""

__version__ = "0.1.0"
