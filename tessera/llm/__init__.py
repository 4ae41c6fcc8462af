"""Operators for building language-model training data from the corpus tables."""
