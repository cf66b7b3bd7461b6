"""Spark-first engine for two-stage visual retrieval and the data work around it."""

__version__ = "0.1.0"
