"""Code cross-reference analytics on Spark DataFrames."""
