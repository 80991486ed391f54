"""Spark-native maximum inner product search and vector analytics."""
