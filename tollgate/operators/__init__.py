"""Detectors and report operators over the prepared table."""
