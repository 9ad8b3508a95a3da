"""Connectors: anything that yields knowledge records, joined in a fixed order, absent ones skipped."""

from __future__ import annotations

import os
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.sources import verbalise as V
from factloom.sources.parse import read_paragraphs

#: Fixed value: least characters of a paragraph that becomes a record.
LEAST_CHARS = 40


def file_product(name: Column | str, rules: tuple[tuple[str, str], ...] = (), default: str = "Unclassified") -> Column:
    """The product a file name stands for: the label of the first rule (part of the name, label) that fits."""
    out = F.lit(default)
    for part, label in reversed(rules):
        out = F.when(F.lower(name).contains(part), label).otherwise(out)
    return out


def file_doc_type(name: Column | str) -> Column:
    """The kind of document a file name stands for; the first rule that fits decides."""
    n = F.lower(name)
    return (
        F.when(n.contains("_review_"), "Review Memorandum").when(n.rlike(r"^k\d{2}"), "510(k) Summary").when(n.contains("quick_reference") | n.contains("reference_manual"), "Quick Reference Guide")
        .when(n.contains("ifu") | n.contains("instruction"), "Instructions For Use").otherwise("Document"))


def file_k_number(name: Column | str) -> Column:
    """The part before the first underscore if the name begins with K, else the empty string."""
    c = F.col(name) if isinstance(name, str) else name
    return F.when(c.startswith("K"), F.regexp_replace(F.substring_index(c, "_", 1), r"\.[A-Za-z0-9]+$", "")).otherwise("")


class Connector(Protocol):
    """One source of records in the common schema."""

    def present(self) -> bool: ...

    def read(self, spark: SparkSession) -> DataFrame: ...


@dataclass
class DocumentConnector:
    """Paragraphs of a folder of files as records; short ones are dropped, broken files are left out."""

    folder: str
    system: str = "Documents"
    domains: dict[str, str] | None = None
    products: tuple[tuple[str, str], ...] = ()

    def present(self) -> bool:
        return os.path.isdir(self.folder)

    def read(self, spark: SparkSession) -> DataFrame:
        rows = read_paragraphs(spark, self.folder).where(F.col("error").isNull() & (F.length("text") >= LEAST_CHARS))
        top = F.element_at(F.split(F.regexp_replace("path", ".*" + os.path.basename(self.folder.rstrip("/")) + "/", ""), "/"), 1)
        mapped = F.create_map(*[F.lit(x) for kv in (self.domains or {"": ""}).items() for x in kv])
        return rows.select(
            F.lit("document").alias("source_type"), F.lit(self.system).alias("source_system"), F.concat("document_name", F.lit("#p"), F.col("paragraph_index").cast("string")).alias("source_id"),
            F.col("document_name").alias("title"), "text", F.lit("document_paragraph").alias("record_type"), F.lit("").alias("year"), "section_path", "page",
            F.coalesce(F.try_element_at(mapped, top), F.lit("General")).alias("domain"), file_product("document_name", self.products).alias("product"), file_doc_type("document_name").alias("doc_type"),
            file_k_number("document_name").alias("k_number"))


@dataclass
class CsvConnector:
    """A folder of registry CSV files with headers and quoted newlines; a missing file is an empty table."""

    folder: str

    TABLES = {
        "510k_clearances.csv": ("k_number device_name applicant decision_date product_code decision_description", V.clearances),
        "product_code_classifications.csv": ("product_code device_name device_class regulation_number", V.classifications),
        "enforcement_reports.csv": ("recall_number product_description reason_for_recall status recall_initiation_date", V.recalls),
        "device_recalls.csv": ("product_res_number event_date_initiated product_description reason_for_recall root_cause_description recall_status product_code", V.device_recalls),
        "nova_ifu_document_index.csv": ("ifu_id title product family doc_type literature_part_number url", V.documents_index),
        "udi_device_identifiers.csv": ("brand_name version_or_model_number device_description product_codes commercial_distribution_status publish_date", V.device_identifiers),
    }

    def present(self) -> bool:
        return os.path.isdir(self.folder)

    def rows(self, spark: SparkSession, name: str) -> DataFrame:
        columns = self.TABLES[name][0].split()
        path = os.path.join(self.folder, name)
        if not os.path.exists(path):
            return spark.createDataFrame([], T.StructType([T.StructField(c, T.StringType()) for c in columns]))
        df = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"')
        return df.select(*[F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in columns])

    def read(self, spark: SparkSession) -> DataFrame:
        return V.union_in_order([make(self.rows(spark, name)) for name, (_, make) in self.TABLES.items()]).drop("source_ord")


def registry(connectors: list[Connector], spark: SparkSession) -> DataFrame | None:
    """Records of all present connectors in the given order, or None if none is present."""
    parts = [c.read(spark) for c in connectors if c.present()]
    return V.union_in_order(parts) if parts else None
