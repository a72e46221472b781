"""Rasters, manifests and fixtures as DataFrames."""
