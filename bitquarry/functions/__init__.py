"""Flags: 16-bit sets of named attributes, masks over them, and their columns."""
