"""Operators for large training-text corpora, one module per operator.

Nothing else in the package imports this folder.  ``queries.py`` holds the
registered queries and their SQL.
"""
