"""All queries of the training-data operators with their SQL where SQL can say it."""

from __future__ import annotations

from factloom.llm import device_queries, mix_queries, queries, scan_queries

QUERIES: dict = {**queries.QUERIES, **device_queries.QUERIES, **scan_queries.QUERIES, **mix_queries.QUERIES}
SQL: dict = {**queries.SQL}
