"""Spark-native analytics for web-page and document corpora."""
