"""Spark-native analytics engine for building, auditing and evaluating document corpora."""
