"""Corpus analytics on PySpark: retrieval, code analytics and change capture over source repositories."""

__version__ = "0.1.0"
