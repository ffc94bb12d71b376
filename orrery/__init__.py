"""Spark-native knowledge-graph, document-retrieval and corpus analytics."""
