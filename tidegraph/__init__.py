"""Frontier graph analytics and data processing on Spark DataFrames."""
