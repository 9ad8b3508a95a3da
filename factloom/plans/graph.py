"""Graph queries over knowledge records and entity mentions, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.functions import lexicons as L
from factloom.operators import graph as G
from factloom.session import table
from factloom.sources.verbalise import keep_first


def _events(spark, d) -> G.Events:
    """Brands of the reference list are the products; where a record was seen goes by its source system."""
    brand = F.get(F.split("canonical_name", " "), 1)
    aliases = table(spark, d, "device_reference").select(F.lower(brand).alias("alias"), brand.alias("product")).distinct()
    records = keep_first(table(spark, d, "knowledge_records"), ["source_id"], ["loaded_at", "title", "text"])
    return G.graph_events(G.canonical_products(records, aliases).withColumn("source_type", F.col("source_system")))


def graph_edges(spark, d):
    return G.graph_edges(_events(spark, d))


def graph_nodes(spark, d):
    e = _events(spark, d)
    return G.graph_nodes(e, G.graph_edges(e))


def graph_node_lists(spark, d):
    joined = lambda c: F.array_join(c, "|").alias(c)
    return G.node_lists(_events(spark, d)).select("key", joined("chunks"), joined("sources"))


def graph_edge_evidence(spark, d):
    return G.edge_evidence(_events(spark, d)).select("a", "b", "type", F.array_join("chunks", "|").alias("chunks"))


def graph_node_documents(spark, d):
    name = F.coalesce(F.col("metadata")["document_name"], F.col("title"))
    docs = keep_first(table(spark, d, "knowledge_records"), ["source_id"], ["loaded_at", "title", "text"]).select(F.col("source_id").alias("chunk"), name.alias("document")).where("document IS NOT NULL")
    return G.node_documents(_events(spark, d), docs)


def graph_stats(spark, d):
    e = _events(spark, d)
    return G.graph_stats(e, G.graph_edges(e))


def cross_source_bridges(spark, d):
    e = _events(spark, d)
    return G.graph_nodes(e, G.graph_edges(e)).where("cross_source").select("key", "mentions", "degree")


def graph_trace_one_hop(spark, d):
    e = _events(spark, d)
    active = e.nodes.where("kind = 'Product'").groupBy("key").agg(F.countDistinct("source").alias("s")).where("s >= 2").select("key")
    return G.trace_one_hop(G.graph_edges(e), active)


def graph_multi_hop(spark, d):
    return G.reachable_regulations(G.graph_edges(_events(spark, d), None))


def graph_neighbours(spark, d):
    return G.neighbours(G.graph_edges(_events(spark, d)))


def entity_table(spark, d):
    return G.entity_table(table(spark, d, "entity_mentions"))


def entity_cooccurrence(spark, d):
    return G.cooccurring(table(spark, d, "entity_mentions"), "chunk_id", "canonical")


def isolated_documents(spark, d):
    return G.isolated_documents(table(spark, d, "entity_mentions"))


_AN = ", ".join(f"CASE WHEN regexp_matches(lower(text), '\\b{t}\\b') THEN '{a}' END" for t, a in L.ANALYTES.items())
_K = lambda kind, name: f"CASE WHEN trim({name}) <> '' AND length(trim({name})) <= 120 THEN '{kind}:' || lower(trim({name})) END"
_G = rf"""
WITH k AS (SELECT * EXCLUDE (source_type), source_system AS source_type, metadata['record_type'] AS rt, metadata['k_number'] AS kn, metadata['product_code'] AS pc, metadata['recall_number'] AS rn, coalesce(metadata['document_name'], title) AS dn,
  lower(coalesce(metadata['device_name'], metadata['product'])) AS nm FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY loaded_at NULLS FIRST, title, text) AS r FROM knowledge_records) WHERE r = 1),
al AS (SELECT DISTINCT lower(string_split(canonical_name, ' ')[2]) AS alias, string_split(canonical_name, ' ')[2] AS product FROM device_reference),
fo AS (SELECT source_id, list(DISTINCT product) AS found FROM (SELECT source_id, unnest(regexp_split_to_array(nm, '[^a-z0-9]+')) AS alias FROM k) JOIN al USING (alias) GROUP BY 1),
b AS (SELECT *, list_filter(coalesce(entities, []), lambda e: e.kind IS NOT NULL AND e.name IS NOT NULL AND e.kind <> 'Product') AS ents, list_distinct(list_filter([{_AN}], lambda x: x IS NOT NULL)) AS ans,
  coalesce(regexp_extract_all(text, '\bK[0-9]{{6,9}}\b')[1:4], []) AS cited FROM k),
c AS (SELECT b.*, coalesce(found, []) AS ps, list_transform(list_filter(ents, lambda e: e.kind = 'Regulation'), lambda e: e.name)[1] AS rg FROM b LEFT JOIN fo USING (source_id)),
n0 AS (SELECT source_id, source_type, u.kind AS kind, u.name AS name FROM (SELECT source_id, source_type, unnest(ents) AS u FROM c)
  UNION ALL SELECT source_id, source_type, 'Clearance', kn FROM c WHERE rt = 'clearance' UNION ALL SELECT source_id, source_type, 'ProductCode', pc FROM c WHERE rt IN ('clearance', 'classification', 'recall')
  UNION ALL SELECT source_id, source_type, 'Regulation', rg FROM c WHERE rt = 'classification' UNION ALL SELECT source_id, source_type, 'Recall', rn FROM c WHERE rt = 'recall'
  UNION ALL SELECT source_id, source_type, 'Document', dn FROM c WHERE rt IN ('ifu_catalogue', 'document_paragraph') UNION ALL SELECT source_id, source_type, 'Product', unnest(ps) FROM c
  UNION ALL SELECT source_id, source_type, 'Analyte', unnest(ans) FROM c UNION ALL SELECT source_id, source_type, 'Clearance', unnest(cited) FROM c),
n AS (SELECT *, kind || ':' || lower(trim(name)) AS key FROM n0 WHERE trim(name) <> '' AND length(trim(name)) <= 120),
p AS (SELECT *, {_K('Product', 'p')} AS pk FROM (SELECT *, unnest(ps) AS p FROM c)),
e0 AS (SELECT source_id, {_K('Clearance', 'kn')} AS a, {_K('ProductCode', 'pc')} AS b, 'GOVERNED_BY' AS type FROM c WHERE rt = 'clearance'
  UNION ALL SELECT source_id, pk, {_K('Clearance', 'kn')}, 'CLEARED_UNDER' FROM p WHERE rt = 'clearance' UNION ALL SELECT source_id, {_K('ProductCode', 'pc')}, {_K('Regulation', 'rg')}, 'CLASSIFIED_UNDER' FROM c WHERE rt = 'classification'
  UNION ALL SELECT source_id, {_K('Recall', 'rn')}, {_K('ProductCode', 'pc')}, 'GOVERNED_BY' FROM c WHERE rt = 'recall' UNION ALL SELECT source_id, {_K('Recall', 'rn')}, pk, 'RECALL_AFFECTS' FROM p WHERE rt = 'recall'
  UNION ALL SELECT source_id, pk, {_K('Document', 'dn')}, 'DOCUMENTED_IN' FROM p WHERE rt IN ('ifu_catalogue', 'document_paragraph')
  UNION ALL SELECT source_id, pk, 'Analyte:' || lower(x), 'MEASURES' FROM (SELECT source_id, pk, unnest(ans) AS x FROM p) UNION ALL SELECT source_id, pk, 'Clearance:' || lower(x), 'CLEARED_UNDER' FROM (SELECT source_id, pk, unnest(cited) AS x FROM p)),
ea AS (SELECT a, b, type, count(*) AS weight, least(count(DISTINCT source_id), 12) AS evidence FROM e0 WHERE a IS NOT NULL AND b IS NOT NULL AND a <> b GROUP BY ALL),
e AS (SELECT * FROM ea ORDER BY weight DESC, a, b, type LIMIT 4000),
dg AS (SELECT key, count(*) AS degree FROM (SELECT a AS key FROM e UNION ALL SELECT b FROM e) GROUP BY 1),
na AS (SELECT key, min(kind) AS kind, count(*) AS mentions, least(count(DISTINCT source_id), 60) AS chunks, count(DISTINCT source_type) AS sources FROM n GROUP BY 1),
ns AS (SELECT key, kind, mentions, chunks, sources, coalesce(degree, 0) AS degree, kind = 'Product' AND sources >= 2 AS cross_source FROM na LEFT JOIN dg USING (key) WHERE degree IS NOT NULL OR mentions >= 3)
"""
_EM = "m AS (SELECT DISTINCT ON (mention_id) lower(trim(canonical)) AS canonical, trim(name) AS name, kind, mention_id, chunk_id, document_id FROM entity_mentions WHERE trim(canonical) <> '')"

QUERIES = {f.__name__: f for f in (
    graph_edges, graph_nodes, graph_node_lists, graph_edge_evidence, graph_node_documents, graph_stats, cross_source_bridges, graph_trace_one_hop, graph_multi_hop, graph_neighbours, entity_table, entity_cooccurrence, isolated_documents)}
SQL = {
    "graph_edges": _G + "SELECT a, b, type, weight, evidence FROM e",
    "graph_nodes": _G + "SELECT * FROM ns",
    "graph_node_lists": _G + """, nr AS (SELECT key, source_id, row_number() OVER (PARTITION BY key ORDER BY source_id) AS r FROM (SELECT DISTINCT key, source_id FROM n)),
nl AS (SELECT key, string_agg(source_id, '|' ORDER BY source_id) AS chunks FROM nr WHERE r <= 60 GROUP BY 1), so AS (SELECT key, string_agg(source_type, '|' ORDER BY source_type) AS sources FROM (SELECT DISTINCT key, source_type FROM n) GROUP BY 1) SELECT key, chunks, sources FROM nl JOIN so USING (key)""",
    "graph_edge_evidence": _G + ", er AS (SELECT a, b, type, source_id, row_number() OVER (PARTITION BY a, b, type ORDER BY source_id) AS r FROM (SELECT DISTINCT a, b, type, source_id FROM e0 WHERE a IS NOT NULL AND b IS NOT NULL AND a <> b)) SELECT a, b, type, string_agg(source_id, '|' ORDER BY source_id) AS chunks FROM er WHERE r <= 12 GROUP BY ALL",
    "graph_node_documents": _G + "SELECT DISTINCT key, dn AS document FROM n JOIN (SELECT source_id, dn FROM k WHERE dn IS NOT NULL) USING (source_id)",
    "graph_stats": _G + "SELECT 'node_count' AS metric, count(*) AS value FROM na UNION ALL SELECT 'edge_count', count(*) FROM e UNION ALL SELECT 'cross_source_products', count(*) FROM na WHERE kind = 'Product' AND sources >= 2 UNION ALL SELECT 'edges:' || type, count(*) FROM e GROUP BY type",
    "cross_source_bridges": _G + "SELECT key, mentions, degree FROM ns WHERE cross_source",
    "graph_trace_one_hop": _G + ", ac AS (SELECT key FROM na WHERE kind = 'Product' AND sources >= 2) SELECT a, b, type, CASE WHEN a NOT IN (SELECT key FROM ac) THEN a WHEN b NOT IN (SELECT key FROM ac) THEN b END AS neighbour FROM e WHERE a IN (SELECT key FROM ac) OR b IN (SELECT key FROM ac)",
    "graph_multi_hop": _G + "SELECT x.a AS product, z.b AS regulation, count(DISTINCT x.b) AS clearances FROM ea x JOIN ea y ON x.b = y.a AND y.type = 'GOVERNED_BY' JOIN ea z ON y.b = z.a AND z.type = 'CLASSIFIED_UNDER' WHERE x.type = 'CLEARED_UNDER' GROUP BY ALL",
    "graph_neighbours": _G + "SELECT key, neighbour, type, weight FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY weight DESC, neighbour, type) AS r FROM (SELECT a AS key, b AS neighbour, type, weight FROM e UNION ALL SELECT b, a, type, weight FROM e)) WHERE r <= 8",
    "entity_table": f"WITH {_EM} SELECT canonical, arg_min(kind, mention_id) AS kind, count(*) AS mentions, count(DISTINCT chunk_id) AS chunks, count(DISTINCT document_id) AS documents FROM m GROUP BY 1 HAVING count(*) >= 2 OR bool_or(regexp_matches(name, '^[A-Z]{{2,6}}$'))",
    "entity_cooccurrence": "WITH m AS (SELECT DISTINCT chunk_id AS k, lower(trim(canonical)) AS i FROM entity_mentions WHERE trim(canonical) <> '' AND chunk_id IS NOT NULL) SELECT x.i AS a, y.i AS b, count(*) AS weight FROM m x JOIN m y ON x.k = y.k AND x.i < y.i GROUP BY ALL HAVING count(*) >= 2",
    "isolated_documents": "WITH b AS (SELECT DISTINCT lower(trim(canonical)) AS c, document_id FROM entity_mentions WHERE trim(canonical) <> '' AND document_id IS NOT NULL), s AS (SELECT c FROM b GROUP BY 1 HAVING count(*) >= 2) SELECT DISTINCT document_id FROM b WHERE document_id NOT IN (SELECT document_id FROM b WHERE c IN (SELECT c FROM s))",
}
