"""Spark-native analytics over website audit data."""
