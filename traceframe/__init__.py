"""Spark-native analytics for repeated measurements and ordered point sequences."""

__version__ = "0.1.0"
