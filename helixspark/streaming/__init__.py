"""Incremental ingest: the per-cell operators are stateless for each cell and run unchanged on micro-batches."""
