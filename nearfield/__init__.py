"""Nearfield: a PySpark-native vector search engine and corpus toolkit."""
