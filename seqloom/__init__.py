"""Spark-native sequence-motif analytics."""
