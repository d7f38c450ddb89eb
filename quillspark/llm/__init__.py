"""Corpus operators for training data: filters, dedup, mixing, classifiers, tokenizers.

Nothing else in the package imports this subpackage.
"""
