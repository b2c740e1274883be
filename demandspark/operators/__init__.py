"""Operators: plain functions from DataFrames and parameters to a DataFrame."""
