"""Run-length, ordered and grid-shaped analytics on Spark DataFrames."""
