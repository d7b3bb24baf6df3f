"""Spark-native analytics for text corpora, vectors and conversational data."""
