"""Batch scoring of prose style with Spark DataFrames."""
