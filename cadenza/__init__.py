"""Spark-native engine for frame-ordered measurement series."""
