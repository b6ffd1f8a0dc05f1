"""Directories, file tables, labels and recordings as DataFrames."""
