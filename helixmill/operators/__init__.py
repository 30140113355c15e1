"""Relational, interval, set, sequence and data-processing operators on DataFrames."""
