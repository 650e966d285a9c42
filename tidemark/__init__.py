"""Spark-native analytics for evidence-backed monitoring metrics."""
