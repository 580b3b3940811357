"""Spark-native engine for building and evaluating datasets of code changes."""
