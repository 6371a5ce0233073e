"""Semantic corpus analytics as Spark DataFrame plans."""
