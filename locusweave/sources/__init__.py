"""Readers and writers of the text and Parquet layouts that variant-effect tables come in."""
