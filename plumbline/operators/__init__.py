"""Data-quality operators: every one takes and returns DataFrames."""
