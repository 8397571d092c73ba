"""Validated frames, moments, and the two physical plans of a permutation test."""
