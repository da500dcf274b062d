"""Corpus processing for research-paper sources and text tables, on Spark DataFrames."""
