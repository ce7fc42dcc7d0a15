"""Operators: functions from DataFrames to a DataFrame, lazy and without driver-side rows."""
