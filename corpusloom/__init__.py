"""Spark-native text-to-knowledge-graph analytics."""
