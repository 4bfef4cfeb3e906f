"""Similarity search and dataset curation over drawing archives, as Spark DataFrame operators."""
