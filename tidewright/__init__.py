"""Spark-native research engine for ordered bar data."""
