"""Spark-native extraction and evaluation of topic subgraphs."""
