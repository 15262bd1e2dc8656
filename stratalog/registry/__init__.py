"""Queries over the test tables, each with the SQL that checks it."""
from stratalog.registry import (  # noqa: F401
    audit_q, context_q, entity_q, ingest_q, period_q, reply_q, search_q, source_q, stream_q, text_q, wave_q)
from stratalog.registry.base import ORACLES, QUERIES  # noqa: F401
