"""Spark-native analytics for population-immunity evidence tables."""

__version__ = "0.1.0"
