"""Spark-native analytics for imaging archives: DataFrame in, DataFrame out."""

__version__ = "0.1.0"
