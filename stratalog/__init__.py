"""stratalog: dated text on Spark, from ingest to day, week, month and year units.

Every public operator takes and returns DataFrames.  ``keys`` names the stream
columns (tenant, author, user ...) that prefix each grouping, join and key; with
``keys=()`` one stream is assumed.
"""

from stratalog.session import build_session, configure

__all__ = ["build_session", "configure"]
