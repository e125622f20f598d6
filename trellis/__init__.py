"""Spark-native retrieval over section trees, with its surrounding data operations."""
