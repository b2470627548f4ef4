"""Ordered, versioned key/value analytics on Spark DataFrames."""
