"""Quillspark operators."""
