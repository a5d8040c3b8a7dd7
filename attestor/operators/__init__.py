"""Operators: functions from DataFrames to a DataFrame. None of them starts a job.

Order matters to many of them (the first record wins, the earliest source is the match), and tables have none, so
inputs carry an ``ordinal`` column wherever it does.
"""
