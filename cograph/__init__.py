"""Spark-native analytics over program slices, retrieval and verdict evaluation."""
