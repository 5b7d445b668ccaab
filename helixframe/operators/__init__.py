"""Sequence operators on DataFrames keyed by example_idx."""
