"""Readers of graph, alignment and annotation text. Each parses a DataFrame of lines (column value), so any text source serves; .gz is read as it is."""
