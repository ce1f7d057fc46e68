"""Spark-native engine for (entity, period)-keyed facts."""
