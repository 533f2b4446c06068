"""Scoring of documents that arrive over time."""
