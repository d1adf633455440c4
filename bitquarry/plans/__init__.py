"""Stored layouts and plans: the index catalogue and block-skipping retrieval."""
