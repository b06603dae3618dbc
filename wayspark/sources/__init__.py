"""Readers and writers: CSV, Parquet, JSON and report files on any Hadoop path."""
