"""Span tables on Spark: run-length-encoded sequence data as DataFrames."""
