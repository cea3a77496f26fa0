"""Batch and streaming analytics as PySpark DataFrame jobs."""
