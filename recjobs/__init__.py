"""Batch jobs for top-N recommendation on Spark: every job takes and returns DataFrames."""
