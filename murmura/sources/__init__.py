"""Readers: text files and parquet tables."""
