"""Continuous runs over a landing folder."""
