"""Behavioural time-series analytics on PySpark DataFrames."""
