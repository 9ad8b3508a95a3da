"""Queries of the problem on scanned text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.scans import repaired
from factloom.session import table


def p5_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repaired(table(spark, sf_dir, "paragraphs"), "paragraph_id", "document_id")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p5_repaired(spark, sf_dir).select("paragraph_id", F.explode("noise").alias("noise")).distinct()


QUERIES = {"p5_found": p5_found, "p5_repaired": p5_repaired}
