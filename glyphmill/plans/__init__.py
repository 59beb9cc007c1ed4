"""Registered queries, their fixtures and composed pipelines."""
