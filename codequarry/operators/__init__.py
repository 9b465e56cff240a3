"""Operators: functions from DataFrames to DataFrames, by area."""
