"""Lodeweave: a Spark-native corpus and retrieval engine."""
