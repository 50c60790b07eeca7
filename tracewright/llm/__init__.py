"""Operators for text corpora and language-model data; nothing else in the library imports this package."""
