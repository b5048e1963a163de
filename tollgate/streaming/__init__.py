"""Stateless detectors on streaming DataFrames."""
