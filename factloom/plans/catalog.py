"""All queries of the core with their ANSI SQL."""

from __future__ import annotations

from factloom.plans import answers, evidence, graph, references, retrieval, structure

FLAGSHIP = "bm25_search"
_PLANS = (retrieval, structure, graph, answers, evidence, references)
QUERIES = {k: f for p in _PLANS for k, f in p.QUERIES.items()}
SQL = {k: s for p in _PLANS for k, s in p.SQL.items()}
