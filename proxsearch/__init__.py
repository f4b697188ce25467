"""Positional full-text search and corpus processing on PySpark."""
