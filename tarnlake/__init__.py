"""Layered data pipelines as Spark DataFrame operations."""
