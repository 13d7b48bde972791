"""Readers of parquet tables and of source text."""
