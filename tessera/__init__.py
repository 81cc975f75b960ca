"""Tessera: DataFrame queries over Parquet tables, written for Spark."""
