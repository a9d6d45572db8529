"""Dyadic event analytics on Spark DataFrames."""
