"""Operators on DataFrames: search, evaluation, gates, declarations and chunks."""
