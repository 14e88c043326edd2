"""Lodestone: a PySpark-native analytics engine for question banks and text corpora."""
