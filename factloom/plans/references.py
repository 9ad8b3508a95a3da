"""Queries of problem 2: orphan references in the registry tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators.orphans import fold_key, orphan_references, orphans_by_month
from factloom.session import table

PAYLOAD = ["source_table", "ref_field", "record_key"]


def registry_references(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(references, parents) of the four registry relations in one pair of streams."""
    clear, codes = table(spark, sf_dir, "clearances_510k"), table(spark, sf_dir, "product_code_classifications")
    recalls, know = table(spark, sf_dir, "enforcement_reports"), table(spark, sf_dir, "knowledge_records")
    refs = clear.select(
        F.lit("codes").alias("target"), fold_key("product_code").alias("key"), F.col("loaded_at").alias("at"),
        F.lit("clearances_510k").alias("source_table"), F.lit("product_code").alias("ref_field"), F.col("k_number").alias("record_key"),
    )
    fields = F.array(*[
        F.struct(F.lit(target).alias("target"), F.lit(f"metadata.{name}").alias("ref_field"), fold_key(F.col("metadata")[name]).alias("key"))
        for name, target in (("product_code", "codes"), ("k_number", "clearances"), ("recall_number", "recalls"))
    ])
    refs = refs.unionByName(
        know.select(F.inline(fields), F.col("loaded_at").alias("at"), F.lit("knowledge_records").alias("source_table"), F.col("source_id").alias("record_key"))
    )
    to = lambda df, target, key, end: df.select(
        F.lit(target).alias("target"), fold_key(key).alias("key"), F.col("loaded_at").alias("valid_from"), end.alias("valid_to")
    )
    parents = (
        to(codes, "codes", "product_code", F.col("deleted_at"))
        .unionByName(to(clear, "clearances", "k_number", F.col("deleted_at")))
        .unionByName(to(recalls, "recalls", "recall_number", F.lit(None).cast("timestamp")))
    )
    return refs, parents


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs, parents = registry_references(spark, sf_dir)
    return orphan_references(refs, parents, PAYLOAD).select(*PAYLOAD, F.date_format("at", "yyyy-MM").alias("period")).distinct()


def p2_orphans_by_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs, parents = registry_references(spark, sf_dir)
    return orphans_by_month(orphan_references(refs, parents, PAYLOAD))


_SQL = r"""
WITH refs AS (
  SELECT 'clearances_510k' AS source_table, 'product_code' AS ref_field, k_number AS record_key, product_code AS raw, loaded_at AS t, 'codes' AS target FROM clearances_510k
  UNION ALL SELECT 'knowledge_records', 'metadata.product_code', source_id, metadata['product_code'], loaded_at, 'codes' FROM knowledge_records
  UNION ALL SELECT 'knowledge_records', 'metadata.k_number', source_id, metadata['k_number'], loaded_at, 'clearances' FROM knowledge_records
  UNION ALL SELECT 'knowledge_records', 'metadata.recall_number', source_id, metadata['recall_number'], loaded_at, 'recalls' FROM knowledge_records
), folded AS (SELECT *, lower(regexp_replace(raw, '^\s+|\s+$', '', 'g')) AS k FROM refs
), asked AS (SELECT * FROM folded WHERE k IS NOT NULL AND k NOT IN ('', 'n/a', 'none', '-', 'unassigned')
), parents AS (
  SELECT 'codes' AS target, lower(regexp_replace(product_code, '^\s+|\s+$', '', 'g')) AS k, loaded_at AS a, deleted_at AS z FROM product_code_classifications
  UNION ALL SELECT 'clearances', lower(regexp_replace(k_number, '^\s+|\s+$', '', 'g')), loaded_at, deleted_at FROM clearances_510k
  UNION ALL SELECT 'recalls', lower(regexp_replace(recall_number, '^\s+|\s+$', '', 'g')), loaded_at, NULL FROM enforcement_reports
), orphans AS (
  SELECT * FROM asked r WHERE NOT EXISTS (SELECT 1 FROM parents p WHERE p.target = r.target AND p.k = r.k AND p.a <= r.t AND (p.z IS NULL OR p.z > r.t))
)
"""

QUERIES = {"p2_found": p2_found, "p2_orphans_by_month": p2_orphans_by_month}
SQL = {
    "p2_found": _SQL + "SELECT DISTINCT source_table, ref_field, record_key, strftime(t, '%Y-%m') AS period FROM orphans",
    "p2_orphans_by_month": _SQL
    + """, s AS (SELECT o.*, CASE WHEN NOT EXISTS (SELECT 1 FROM parents p WHERE p.target = o.target AND p.k = o.k) THEN 'missing'
      WHEN NOT EXISTS (SELECT 1 FROM parents p WHERE p.target = o.target AND p.k = o.k AND p.a <= o.t) THEN 'late' ELSE 'deleted' END AS status FROM orphans o)
    SELECT source_table, ref_field, strftime(t, '%Y-%m') AS period, status, count(DISTINCT record_key) AS records FROM s GROUP BY ALL""",
}
