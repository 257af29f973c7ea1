"""Palimpsest: layered file catalogues, dependency graphs and corpus operators on Spark DataFrames."""

__version__ = "0.1.0"
