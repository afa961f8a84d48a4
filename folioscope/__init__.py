"""Spark-native search and analysis of offline page archives."""
