"""Spark-native latency and value analytics: mergeable fixed-slot histograms over DataFrames."""
