"""Spark-native analytics for experiment and benchmark results."""

__version__ = "0.1.0"
