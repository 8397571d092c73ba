"""Permutation inference for regression on Spark DataFrames."""
