"""Readers that turn external formats into DataFrames."""
