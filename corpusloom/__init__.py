"""Spark-native retrieval, code-graph and corpus preparation operators."""
