"""Spark-native analytics over text knowledge bases."""
