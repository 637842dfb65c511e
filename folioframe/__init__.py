"""Spark-first recovery of tables from positioned text, plus corpus operators."""

__version__ = "0.1.0"
