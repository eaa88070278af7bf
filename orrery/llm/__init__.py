"""Operators for text corpora (problems 1, 6, 7 and 8)."""
