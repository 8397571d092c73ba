"""Tail probabilities and text forms of results."""
