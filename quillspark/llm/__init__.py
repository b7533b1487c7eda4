"""Corpus operators for language-model training data; nothing else in quillspark imports this package."""
