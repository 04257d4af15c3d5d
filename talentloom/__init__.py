"""Talent-search analytics on Spark DataFrames."""
