"""Weftgraph: labelled property graphs as DataFrames, queried by pattern."""
