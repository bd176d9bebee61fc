"""Operators: plain functions from DataFrames to DataFrames, told which columns to use."""
