"""Operators for large-scale training-data preparation.

Nothing outside this package imports it. ``queries.py`` holds the registered
queries, ``oracles.py`` the SQL they are held against.
"""
