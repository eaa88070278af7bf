"""Recursive-descent syntax checkers, one module per language family."""
