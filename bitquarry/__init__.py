"""Spark-native bit-flag index and query engine."""
