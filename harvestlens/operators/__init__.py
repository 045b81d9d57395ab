"""Operators: functions from DataFrames to DataFrames. None of them runs a job."""
