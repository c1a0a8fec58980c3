"""Corpus operators for training data: search, mixing, archives, de-duplication, quality, privacy, leakage, tokens.

Nothing else in the library imports this subpackage.
"""
