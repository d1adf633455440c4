"""Index building and merging, mask queries, comparison and reports."""
