"""Operators: functions from DataFrames to DataFrames, for use with df.transform()."""
