"""Spark-native code-health analytics."""
