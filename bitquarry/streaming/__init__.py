"""Incremental building of a stored index from streams."""
