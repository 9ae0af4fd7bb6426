"""Corpus operators for language-model training data, one module for each operator."""
