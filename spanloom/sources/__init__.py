"""Spans and observations as DataFrames."""
