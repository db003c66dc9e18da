"""Operators: functions from DataFrames to DataFrames, keyed by recording, timeline or plan."""
