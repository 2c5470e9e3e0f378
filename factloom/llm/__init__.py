"""Operators for preparing language-model training text.

Nothing else in ``factloom`` imports this package. ``queries.py`` holds the
registered queries and their SQL.
"""
