"""Operators on DataFrames: joins, graphs, ranking and aggregation."""
