"""Corpus analytics on Spark: rank, price, de-duplicate and pack text collections."""

__version__ = "0.1.0"
