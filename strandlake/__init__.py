"""Spark-native analytics over sequences, annotations, text and columnar cells."""
