"""Patch-embedding analytics on Spark DataFrames."""
