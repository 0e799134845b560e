"""Spark-native imagery analytics."""
