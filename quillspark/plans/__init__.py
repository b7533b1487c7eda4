"""Quillspark plans."""
