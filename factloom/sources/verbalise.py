"""Structured rows as knowledge records: a key, a title, a sentence and metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factloom.functions.text import or_default, sanitize


def _record(df: DataFrame, key: Column, kind: str, title: Column, text: Column, year: Column | None = None, more: dict[str, Column] | None = None) -> DataFrame:
    return df.select(
        F.lit("registry").alias("source_type"), F.lit("Registry").alias("source_system"), key.alias("source_id"), title.alias("title"), text.alias("text"), F.lit(kind).alias("record_type"),
        F.coalesce(year, F.lit("")).alias("year") if year is not None else F.lit("").alias("year"), *[c.alias(n) for n, c in (more or {}).items()],
    ).where("source_id <> ''")


def clearances(df: DataFrame) -> DataFrame:
    """One record per clearance row; rows with a blank key are skipped."""
    k, name = sanitize("k_number"), or_default("device_name", "an unnamed device")
    text = F.concat(or_default("applicant", "An applicant"), F.lit(" notified "), name, F.lit(" as "), k, F.lit("; the decision was "), F.lower(or_default("decision_description", "not stated")), F.lit(" under code "), or_default("product_code", "not stated"), F.lit("."))
    return _record(df, k, "clearance", F.concat(k, F.lit(" - "), name), text, F.substring(sanitize("decision_date"), 1, 4))


def classifications(df: DataFrame) -> DataFrame:
    code, name = sanitize("product_code"), or_default("device_name", "an unnamed device type")
    text = F.concat(F.lit("Code "), code, F.lit(" covers "), name, F.lit(", class "), or_default("device_class", "not stated"), F.lit(", regulation "), or_default("regulation_number", "not stated"), F.lit("."))
    return _record(df, F.when(code != "", F.concat(F.lit("CODE-"), code)).otherwise(""), "classification", F.concat(F.lit("Code "), code, F.lit(" - "), name), text)


def recalls(df: DataFrame) -> DataFrame:
    """One record per recall; a recall without a number goes by its date, the product is cut to 60 characters in the title."""
    key = F.when(sanitize("recall_number") != "", sanitize("recall_number")).otherwise(F.concat(F.lit("RECALL-"), sanitize("recall_initiation_date")))
    text = F.concat(F.lit("Recall of "), or_default("product_description", "an unnamed product"), F.lit(" because: "), or_default("reason_for_recall", "not stated"), F.lit(" Status: "), or_default("status", "not stated"), F.lit("."))
    return _record(df, key, "recall", F.concat(F.lit("Recall "), key, F.lit(" - "), F.substring(sanitize("product_description"), 1, 60)), text, F.substring(sanitize("recall_initiation_date"), 1, 4))


def catalogue_key() -> Column:
    """The entry's own key where there is one, else its part number, else the beginning of its title."""
    own, part = sanitize("ifu_id"), sanitize("literature_part_number")
    return F.when(own != "", own).otherwise(F.concat(F.lit("IFU-"), F.when(part != "", part).otherwise(F.substring(sanitize("title"), 1, 30))))


def documents_index(df: DataFrame) -> DataFrame:
    """One record per catalogued document; blank titles are skipped and the address is named where there is one."""
    url = F.when(sanitize("url") != "", F.concat(F.lit(" It is published at "), sanitize("url"), F.lit("."))).otherwise("")
    text = F.concat(F.lit("The catalogue lists "), sanitize("title"), F.lit(" for "), or_default("product", "an unnamed product"), F.lit(" as "), or_default("doc_type", "a document"), F.lit("."), url)
    return _record(df.where(sanitize("title") != ""), catalogue_key(), "ifu_catalogue", sanitize("title"), text)


def severity_signal(cause: Column | str) -> Column:
    """Whether a recall's root cause names software."""
    return F.when(F.lower(sanitize(cause)).contains("software"), "software").otherwise("other")


def device_recalls(df: DataFrame) -> DataFrame:
    """One record per recall with its root cause; one without a number goes by its date."""
    number, day, product = sanitize("product_res_number"), sanitize("event_date_initiated"), sanitize("product_description")
    key = F.when(number != "", number).otherwise(F.concat(F.lit("RECALL-"), day))
    text = F.concat(
        F.lit("Recall "), number, F.lit(" began on "), or_default("event_date_initiated", "an unrecorded date"), F.lit(" for: "), product, F.lit(". Reason: "), sanitize("reason_for_recall"),
        F.lit(" Root cause: "), or_default("root_cause_description", "not classified"), F.lit(". Status: "), or_default("recall_status", "unrecorded"), F.lit("."))
    marked = df.withColumn("__severity", severity_signal("root_cause_description"))
    return _record(marked, key, "recall", F.concat(F.lit("Recall "), key, F.lit(" - "), F.substring(product, 1, 60)), text, F.substring(day, 1, 4), {"severity_signal": F.col("__severity"), "product_code": sanitize("product_code")})


def device_identifiers(df: DataFrame, order: str | None = None) -> DataFrame:
    """One record per (brand, model), the first by ``order``; blank brands are skipped, the first of several codes is kept."""
    named = df.withColumns({"__b": sanitize("brand_name"), "__m": sanitize("version_or_model_number")}).where("__b <> ''")
    first = keep_first(named, ["__b", "__m"], [order or "publish_date", "device_description", "product_codes"])
    codes = sanitize("product_codes")
    text = F.concat(
        F.lit("Registration of "), F.col("__b"), F.lit(", model "), F.when(F.col("__m") != "", F.col("__m")).otherwise("unspecified"), F.lit(". "), sanitize("device_description"), F.lit(" Codes: "), or_default("product_codes", "none recorded"),
        F.lit(". Distribution: "), or_default("commercial_distribution_status", "unrecorded"), F.lit("."))
    key = F.substring(F.concat(F.lit("UDI-"), F.col("__b"), F.lit("-"), F.col("__m")), 1, 80)
    return _record(first, key, "udi", F.trim(F.concat_ws(" ", "__b", "__m")), text, None, {"product_code": F.trim(F.substring_index(codes, ";", 1))})


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key by an explicit order, unlike an unordered duplicate drop."""
    seq = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__r", F.row_number().over(seq)).where("__r = 1").drop("__r")


def union_in_order(parts: list[DataFrame]) -> DataFrame:
    """All records with the place of their source; absent sources are left out by the caller."""
    numbered = [p.withColumn("source_ord", F.lit(i)) for i, p in enumerate(parts)]
    out = numbered[0]
    for p in numbered[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out
