"""Benchmark-corpus building and evaluation analytics on Spark DataFrames."""
