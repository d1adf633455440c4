"""Operators for preparing training data at scale.

Nothing outside this subpackage imports it.  ``queries.py`` holds the thin
queries and their SQL; the operators have their own general interfaces.
"""
