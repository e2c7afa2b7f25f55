"""Gablework: corpus preparation, retrieval and record analytics on PySpark."""

__version__ = "0.1.0"
