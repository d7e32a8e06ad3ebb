"""Findings analytics on Spark: load, normalise, score, track, compare and report."""

__version__ = "0.1.0"
