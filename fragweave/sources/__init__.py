"""Readers of assembly, coverage and marker files as DataFrames, and writers."""
