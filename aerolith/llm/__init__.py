"""Operators for training-data pipelines.

Nothing outside this package imports it.  ``queries.py`` holds the query and
SQL registries that ``__spark_entry__.py`` picks up when the package exists.
"""
