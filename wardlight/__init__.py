"""Spark-native engine for governed, read-only clinical analytics."""
