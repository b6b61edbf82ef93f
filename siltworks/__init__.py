"""Layered data flows and data-quality checks as ordinary Spark DataFrame jobs."""
