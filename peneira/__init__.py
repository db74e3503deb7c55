"""Spark-native crawl analytics, text search and data preparation."""

__version__ = "0.1.0"
