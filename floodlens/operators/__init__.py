"""Analytics operators: functions from DataFrames to DataFrames, lazy and free of driver loops."""
