"""Declared-state reconciliation on Spark DataFrames and Structured Streaming."""
