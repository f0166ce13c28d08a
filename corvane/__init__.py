"""Semantic retrieval and expert ranking on Spark."""

__version__ = "0.1.0"
