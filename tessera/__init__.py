"""Tessera: corpus indexing, hybrid retrieval and symbol analytics on Spark DataFrames."""

__version__ = "0.1.0"
