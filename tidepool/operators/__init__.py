"""Relational and time-series operators: functions from DataFrames to DataFrames."""
