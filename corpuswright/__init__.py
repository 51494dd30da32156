"""Spark-native document analytics for research and patent corpora."""
