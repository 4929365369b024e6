"""Retrieval analytics over measurement data, expressed as Spark plans."""

__version__ = "0.1.0"
