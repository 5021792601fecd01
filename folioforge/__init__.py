"""Spark-native analytics and recommendation engine for rating data."""

__version__ = "0.1.0"
