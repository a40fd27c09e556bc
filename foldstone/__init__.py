"""Versioned key-value analytics and table maintenance on Spark DataFrames."""
