"""Spark-native transaction risk analytics: scoring, warehouse queries, quality, streams and models."""
