"""Spark-native analytics over panels of market time series."""
