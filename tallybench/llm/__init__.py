"""Operators and queries for preparing text corpora for language-model training."""
