"""Operators of a training-data pipeline over documents, benchmark items and web pages.

Nothing else in the library imports this subpackage.
"""
