"""Operators for preparing training corpora, and the queries that apply them.

Nothing else in the package imports this subpackage, so it can be removed as a whole.
"""
