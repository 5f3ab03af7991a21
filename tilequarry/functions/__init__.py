"""Scalar helpers, geometry of run tables, timings and logs."""
