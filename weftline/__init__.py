"""Alignment analytics on Spark: DataFrame and SQL operators over candidate mappings, reference sets, triples and vectors."""

__version__ = "0.1.0"
