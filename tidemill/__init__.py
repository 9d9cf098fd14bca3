"""Spark jobs for large document collections."""
