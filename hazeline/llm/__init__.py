"""Operators for large text corpora: one module per operator, ``catalog`` holds their queries."""
