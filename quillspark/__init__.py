"""Quillspark: learning analytics and corpus preparation on Apache Spark."""
