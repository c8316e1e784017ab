"""Ranked retrieval over DataFrames: full text, vectors and their fusion."""
