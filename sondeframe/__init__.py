"""Spark-native analytics of ordered vertical profiles."""
