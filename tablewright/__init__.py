"""Spark-native table engine: describe, ingest, profile, compare and query tabular data."""
