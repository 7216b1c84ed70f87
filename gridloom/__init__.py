"""Spark-native analytics over gridded data."""
