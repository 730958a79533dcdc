"""Spectraloom: a Spark-first engine for scientific record pipelines."""

__version__ = "0.1.0"
