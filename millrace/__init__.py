"""Ordered, stateful and time-aware data processing, planned as DataFrames."""
