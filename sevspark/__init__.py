"""Severity analytics for multi-table incident data, written on PySpark DataFrames."""
