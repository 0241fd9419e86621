"""Spark-native hybrid retrieval over text and source code."""

__version__ = "0.1.0"
