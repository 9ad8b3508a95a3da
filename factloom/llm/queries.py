"""Queries of the text problems that need no trained model, with SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.cooccurrence import item_pairs
from factloom.llm.furniture_lines import repeated_lines, without_repeated_lines
from factloom.llm.leakage import leaked_items
from factloom.llm.pieces import split_oversized
from factloom.llm.truncation import truncated_documents, truncation_by_source
from factloom.session import table


def _oversized(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = lambda name, kind, key: table(spark, sf_dir, name).select(F.lit(kind).alias("item_kind"), F.col(key).alias("item_id"), "text")
    return of("chunks", "chunk", "chunk_id").unionByName(of("paragraphs", "paragraph", "paragraph_id"))


def p3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_oversized(_oversized(spark, sf_dir), ["item_kind", "item_id"])


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p3_pieces(spark, sf_dir).where("piece_no = 1 AND n_pieces > 1").select("item_kind", "item_id").distinct()


def p4_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = item_pairs(table(spark, sf_dir, "entity_mentions"), "chunk_id", "canonical")
    return p.select(F.col("item_a").alias("canonical_a"), F.col("item_b").alias("canonical_b"), "n_a", "n_b", "n_ab", F.round("lift", 6).alias("lift"), F.round("pmi", 6).alias("pmi"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p4_pairs(spark, sf_dir).select("canonical_a", "canonical_b")


def _lines(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    chunks = table(spark, sf_dir, "chunks")
    return (chunks, *repeated_lines(chunks, "chunk_id", "document_id", "source_system"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir)[1].where("literal").select(F.col("item").alias("chunk_id"), "line_no").distinct()


def p6_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks, hits, _ = _lines(spark, sf_dir)
    return without_repeated_lines(chunks, hits.where("literal"), "chunk_id")


def p6_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir)[2].withColumnRenamed("source", "source_system")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaked_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark_items"), "doc_id", "item_id").select("item_id", "doc_id")


def p8_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaked items with the number of documents that hold a passage of each."""
    return p8_found(spark, sf_dir).groupBy("item_id").agg(F.count("*").alias("documents"))


def _cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncated_documents(table(spark, sf_dir, "documents"), "doc_id", "source")


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cut(spark, sf_dir).where("truncated").select("doc_id")


def p10_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation_by_source(_cut(spark, sf_dir))


_P4 = r"""
WITH m AS (SELECT DISTINCT chunk_id AS b, lower(regexp_replace(canonical, '^\s+|\s+$', '', 'g')) AS i FROM entity_mentions
  WHERE canonical IS NOT NULL AND chunk_id IS NOT NULL AND regexp_replace(canonical, '^\s+|\s+$', '', 'g') <> ''),
t AS (SELECT count(DISTINCT b) AS nn FROM m), s AS (SELECT i, count(*) AS n FROM m GROUP BY i),
p AS (SELECT x.i AS a, y.i AS z, count(*) AS n_ab FROM m x JOIN m y ON x.b = y.b AND x.i < y.i GROUP BY ALL),
r AS (SELECT a AS canonical_a, z AS canonical_b, sa.n AS n_a, sb.n AS n_b, n_ab, n_ab * nn / (sa.n * sb.n) AS l FROM p JOIN s sa ON sa.i = a JOIN s sb ON sb.i = z, t
  WHERE n_ab >= 5 AND n_ab >= 0.001::DOUBLE * nn AND n_ab * nn >= 5 * sa.n * sb.n)
"""
_P6 = r"""
WITH c AS (SELECT DISTINCT chunk_id, document_id, source_system, section_path, text FROM chunks),
x AS (SELECT chunk_id, document_id, source_system, section_path, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM c),
l AS (SELECT chunk_id, document_id, source_system, line_no, list_transform(section_path, lambda e: regexp_replace(regexp_replace(regexp_replace(lower(e), '[ \t\r]+', ' ', 'g'), '^ | $', '', 'g'), '[0-9]+', '0', 'g')) AS path,
  regexp_replace(regexp_replace(regexp_replace(lower(raw), '[ \t\r]+', ' ', 'g'), '^ | $', '', 'g'), '[0-9]+', '0', 'g') AS line FROM x),
k AS (SELECT * FROM l WHERE line <> '' AND NOT coalesce(list_contains(path, line), false)),
n AS (SELECT source_system, count(DISTINCT document_id) AS n FROM chunks GROUP BY 1),
f AS (SELECT source_system, line, count(DISTINCT document_id) AS d FROM k GROUP BY ALL),
g AS (SELECT f.* FROM f JOIN n ON f.source_system IS NOT DISTINCT FROM n.source_system WHERE d >= 5 AND d >= 0.04::DOUBLE * n.n)
"""
_P8 = r"""
WITH w AS (SELECT 'd' AS k, doc_id AS id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents
  UNION ALL SELECT 'i', item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') FROM benchmark_items),
g AS (SELECT DISTINCT k, id, array_to_string(w[s:s + 11], ' ') AS g FROM (SELECT k, id, w, unnest(generate_series(1, len(w) - 11)) AS s FROM w WHERE len(w) >= 12)),
r AS (SELECT DISTINCT i.id AS item_id, d.id AS doc_id FROM g i JOIN g d ON i.g = d.g AND i.k = 'i' AND d.k = 'd')
"""

QUERIES = {
    "p3_found": p3_found, "p3_pieces": p3_pieces, "p4_found": p4_found, "p4_pairs": p4_pairs,
    "p6_found": p6_found, "p6_cleaned": p6_cleaned, "p6_templates": p6_templates,
    "p8_found": p8_found, "p8_items": p8_items, "p10_found": p10_found, "p10_by_source": p10_by_source,
}
SQL = {
    "p3_found": "SELECT DISTINCT 'chunk' AS item_kind, chunk_id AS item_id FROM chunks WHERE length(text) > 1000 UNION SELECT 'paragraph', paragraph_id FROM paragraphs WHERE length(text) > 1000",
    "p4_found": _P4 + "SELECT canonical_a, canonical_b FROM r",
    "p4_pairs": _P4 + "SELECT canonical_a, canonical_b, n_a, n_b, n_ab, round(l, 6) AS lift, round(ln(l), 6) AS pmi FROM r",
    "p6_found": _P6 + "SELECT DISTINCT chunk_id, CAST(line_no AS BIGINT) AS line_no FROM k JOIN g ON k.source_system IS NOT DISTINCT FROM g.source_system AND k.line = g.line",
    "p6_cleaned": _P6 + r"""
, h AS (SELECT DISTINCT chunk_id, line_no FROM k JOIN g ON k.source_system IS NOT DISTINCT FROM g.source_system AND k.line = g.line),
z AS (SELECT DISTINCT chunk_id, text FROM chunks),
u AS (SELECT chunk_id, text, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM z WHERE text IS NOT NULL)
SELECT u.chunk_id, coalesce(string_agg(raw, chr(10) ORDER BY u.line_no) FILTER (WHERE h.line_no IS NULL), '') AS text FROM u LEFT JOIN h ON u.chunk_id = h.chunk_id AND u.line_no = h.line_no
GROUP BY u.chunk_id, u.text UNION ALL SELECT chunk_id, text FROM z WHERE text IS NULL""",
    "p8_found": _P8 + "SELECT item_id, doc_id FROM r",
    "p8_items": _P8 + "SELECT item_id, count(*) AS documents FROM r GROUP BY 1",
}
