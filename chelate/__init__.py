"""Coordination-chemistry analytics on Spark DataFrames."""
