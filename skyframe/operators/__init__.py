"""Joins, reductions, windows and spatial jobs over particle and catalog tables."""
