"""Spark-native evaluation, routing and release-gating analytics."""
