"""Corpus curation, packing and experiment analytics as Spark DataFrame operators."""
