"""Whole plans: guides for papers, and translation from source files to finished ones."""
