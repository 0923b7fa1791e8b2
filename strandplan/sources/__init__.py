"""Readers and writers for the text and GeoJSON formats."""
