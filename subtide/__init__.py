"""Spark-native analytics over time-stamped, multilingual text."""
