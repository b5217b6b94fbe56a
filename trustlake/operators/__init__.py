"""Checks, trust queries, gates, metrics, graph and alerts over DataFrames."""
