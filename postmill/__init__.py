"""Postmill: a PySpark-native engine for posting-style record feeds."""
