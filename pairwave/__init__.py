"""Spark-native analysis of paired physiological time series."""
