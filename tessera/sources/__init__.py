"""Readers for the Parquet tables."""
