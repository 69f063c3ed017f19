"""Readers and writers: CSV landing, by-name union, typed Parquet tables, views."""
