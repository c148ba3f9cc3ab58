"""Keyed mutation-log analytics on Spark DataFrames."""
