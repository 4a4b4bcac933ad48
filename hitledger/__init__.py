"""Spark-native reliability analytics for web, transaction and state event logs."""
