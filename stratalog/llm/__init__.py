"""Operators for preparing training data: archives, deduplication, filters, packing.

Nothing else in the library imports this package; its queries are in
``stratalog.llm.queries``.
"""
