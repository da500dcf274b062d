"""Rewrites of TeX sources, in a fixed order: compat.py for XeLaTeX, document.py for main files."""
