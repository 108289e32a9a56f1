"""Temporal hybrid search over versioned, hierarchical text, on Spark DataFrames."""
