"""Operators on document tables: DataFrame in, DataFrame out, keyed by document and page."""
