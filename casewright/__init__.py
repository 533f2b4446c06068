"""Curate, label, clean and evaluate large text corpora with Spark DataFrames."""
