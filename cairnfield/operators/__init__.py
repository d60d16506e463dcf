"""Transformations over DataFrames keyed by map."""
