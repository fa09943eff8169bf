"""Spark-native analytics over timestamped media content."""

__version__ = "0.1.0"
