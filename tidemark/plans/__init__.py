"""Whole queries, composed from operators; each returns lazily planned DataFrames."""
