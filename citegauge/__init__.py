"""Spark-native citation verification engine."""
