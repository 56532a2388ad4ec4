"""Operators for large text corpora, by the method each module names."""
