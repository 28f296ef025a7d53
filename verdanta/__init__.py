"""Spark-native analytics over multi-date imagery held as tables."""
