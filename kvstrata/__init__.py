"""Versioned key-value tables as DataFrames: reads, compaction, metadata, change feeds and streaming ingest."""
