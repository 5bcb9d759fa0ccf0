"""Radar and interferometry analytics on Spark DataFrames."""
