"""Spark jobs for financial statements and training-data corpora."""
