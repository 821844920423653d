"""Orrery: a Spark-native engine for asset metadata search, filtering, de-duplication and statistics."""
