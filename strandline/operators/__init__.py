"""Operators on graph tables; every one takes and returns DataFrames."""
