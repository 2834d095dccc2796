"""Codebase-knowledge analytics on Spark DataFrames."""
