"""Spark-native corpus sync, hybrid retrieval and corpus maintenance."""
