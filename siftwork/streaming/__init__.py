"""Incremental (Structured Streaming) ingestion."""

from .landing import ingest_new_keys

__all__ = ["ingest_new_keys"]
