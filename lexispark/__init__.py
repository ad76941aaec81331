"""Spark-native corpus analytics: DataFrame operators for large transcript and text corpora."""
