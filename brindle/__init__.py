"""Spark-native analytics over tables and documents: every operator is DataFrames in, one DataFrame out."""
