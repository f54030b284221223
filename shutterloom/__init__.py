"""Spark-native curation analytics: ordering, sessionising, judging and writing back media frames."""
