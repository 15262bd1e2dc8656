"""Incremental ingest with Structured Streaming."""
from stratalog.streaming.ingest import (  # noqa: F401
    ingest_stream, merge_batch, merge_stream, read_stream, usage_stream)
