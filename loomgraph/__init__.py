"""Spark-native knowledge-graph retrieval and analytics."""
