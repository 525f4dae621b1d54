"""Spark-first analytics for text, concept hierarchies and term pairs."""
