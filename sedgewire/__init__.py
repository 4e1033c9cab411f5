"""Spark-native analytics over file scans, and operators for text corpora."""
