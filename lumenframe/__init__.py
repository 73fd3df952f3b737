"""Spark-first analytics for provenance-aware optical measurement data."""

__version__ = "0.1.0"
