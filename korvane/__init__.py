"""Retrieval analytics and text processing as plain Spark DataFrame jobs."""
