"""Quillspark functions."""
