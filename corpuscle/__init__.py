"""Corpuscle: corpus analytics on Spark DataFrames."""
