"""Barquill: market time-series analytics as plain Spark jobs."""
