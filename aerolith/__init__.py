"""Spark-native analytics over position reports."""
