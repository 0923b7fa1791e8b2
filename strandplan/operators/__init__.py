"""Relational, spatial and graph operators (DataFrame in, DataFrame out)."""
