"""Facet, trend, graph, search and quality operators on DataFrames."""
