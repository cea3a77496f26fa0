"""Readers, generators and the views of jobs' entities over the given tables."""
