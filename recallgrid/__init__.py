"""Spark-native analytics over long-term agent memory tables."""
