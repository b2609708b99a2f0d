"""Spark-native document chunking analytics and corpus preparation."""
