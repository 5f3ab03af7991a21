"""Rasters as relations."""
