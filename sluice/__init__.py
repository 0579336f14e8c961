"""Spark-native queries over JSON event topics, in batch and with Structured Streaming."""
