"""Whole jobs assembled from sources, functions and operators."""
