"""Operators: functions from DataFrames to DataFrames, the same in batch and in foreachBatch."""
