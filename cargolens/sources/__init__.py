"""Readers and writers: CSV, Parquet marts, staged tables and the star-schema binding."""
