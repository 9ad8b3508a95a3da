"""Queries of the two problems on device records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.canonical import map_devices
from factloom.llm.devices import reference_parser
from factloom.llm.matching import match_records
from factloom.session import table


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = lambda name, key, text: table(spark, sf_dir, name).select(F.col(key).alias("key"), F.lit(text).alias("field"), F.col(text).alias("text"))
    return of("clearances_510k", "k_number", "device_name").unionByName(of("enforcement_reports", "recall_number", "product_description"))


def p7_mapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return map_devices(_texts(spark, sf_dir), table(spark, sf_dir, "device_reference")).withColumnRenamed("key", "record_key")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p7_mapped(spark, sf_dir).select("record_key", "ref_id").distinct()


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every attribute of the three tables that may tell one device from another."""
    year = lambda c: F.regexp_extract(c, r"(?<![0-9])((?:19|20)[0-9]{2})(?:[0-9]{4})?(?![0-9])", 1)
    none = F.lit(None).cast("string")
    of = lambda name, key, text, **more: table(spark, sf_dir, name).select(
        F.col(key).alias("key"), F.lit(text).alias("field"), F.col(text).alias("text"), *[more.get(c, none).alias(c) for c in ("maker", "city", "state", "kind", "year")])
    return (
        of("clearances_510k", "k_number", "device_name", maker=F.col("applicant"), city=F.col("city"), state=F.col("state"), year=year("decision_date"))
        .unionByName(of("enforcement_reports", "recall_number", "product_description", city=F.col("city"), state=F.col("state"), year=year("recall_initiation_date")))
        .unionByName(of("nova_ifu_document_index", "ifu_id", "product", kind=F.col("family"))))


def p1_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = _records(spark, sf_dir)
    return match_records(records, reference_parser(table(spark, sf_dir, "device_reference"), texts=records))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p1_pairs(spark, sf_dir).select("a_key", "b_key")


QUERIES = {"p1_found": p1_found, "p1_pairs": p1_pairs, "p7_found": p7_found, "p7_mapped": p7_mapped}
