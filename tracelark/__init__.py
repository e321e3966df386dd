"""Spark-native analysis of execution traces of parallel programs."""
