"""Preference-data analytics on Spark DataFrames."""
