"""Spark-native documentation index: crawl catalogue, extraction, chunking, vector search, reconciliation."""

__version__ = "0.1.0"
