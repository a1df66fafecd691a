"""Corpus and retrieval analytics as Spark DataFrame operators."""
