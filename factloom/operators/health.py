"""Health, risk and insight figures of a corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factloom.functions.text import boilerplate_section


def health_metrics(chunks: DataFrame, mentions: DataFrame, documents: DataFrame, as_of: str, passages: int = 8, linkage: float = 0.35) -> DataFrame:
    """(metric, raw, score): coverage, connectivity, provenance and freshness, each scored 0 to 100.

    coverage: chunks per document against ``passages``.  connectivity: share of entities in two documents or more
    against ``linkage``.  provenance: share of documents with a date.  freshness: the median age in days at ``as_of`` (upper of the
    middle two), full at 730 and gone at 2190.  Empty inputs score 0.
    """
    pct = lambda c: F.round(100 * F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)), 2)
    row = lambda name, df, raw, share: df.select(F.lit(name).alias("metric"), F.round(F.coalesce(raw, F.lit(0.0)), 6).alias("raw"), pct(F.coalesce(share, F.lit(0.0))).alias("score"))
    per = chunks.agg(F.try_divide(F.countDistinct("chunk_id"), F.countDistinct("document_id")).alias("x"))
    ents = mentions.select(F.lower(F.trim("canonical")).alias("c"), "document_id").where("c <> '' AND document_id IS NOT NULL").distinct().groupBy("c").agg(F.count("*").alias("n"))
    linked = ents.agg(F.avg((F.col("n") >= 2).cast("double")).alias("x"))
    dates = documents.agg(F.avg(F.col("published_at").isNotNull().cast("double")).alias("x"))
    ages = documents.where("published_at IS NOT NULL").select(F.date_diff(F.lit(as_of).cast("date"), F.to_date("published_at")).alias("age"))
    # an exact order statistic from a histogram of ages, which is small whatever the rows
    hist = ages.groupBy("age").agg(F.count("*").alias("n"))
    run = hist.select("age", F.sum("n").over(W.orderBy("age")).alias("upto"), F.sum("n").over(W.partitionBy(F.lit(1))).alias("all"))
    median = run.where(F.col("upto") > F.floor(F.col("all") / 2)).agg(F.min("age").cast("double").alias("x"))
    return (
        row("coverage", per, F.col("x"), F.col("x") / passages).unionAll(row("connectivity", linked, F.col("x"), F.col("x") / linkage)).unionAll(row("provenance", dates, F.col("x"), F.col("x")))
        .unionAll(row("freshness", median, F.col("x"), (2190 - F.col("x")) / (2190 - 730)))
    )


def health_overall(metrics: DataFrame) -> DataFrame:
    """(overall, band, weakest, strongest): unweighted mean; ties go to the metric first by name."""
    mean = F.round(F.avg("score"), 2)
    return metrics.agg(
        mean.alias("overall"), F.when(mean >= 75, "healthy").when(mean >= 50, "fair").when(mean >= 30, "weak").otherwise("poor").alias("band"),
        F.min_by("metric", F.struct("score", "metric")).alias("weakest"), F.min_by("metric", F.struct(-F.col("score"), F.col("metric"))).alias("strongest"))


def risks(chunks: DataFrame, mentions: DataFrame, documents: DataFrame, isolated: DataFrame) -> DataFrame:
    """(risk, n): furniture chunks, entities named once, isolated documents and undated documents."""
    one = lambda name, df: df.select(F.lit(name).alias("risk"), F.col("n"))
    once = mentions.where("trim(canonical) <> ''").dropDuplicates(["mention_id"]).groupBy(F.lower(F.trim("canonical")).alias("c")).agg(F.count("*").alias("k")).agg(F.count_if(F.col("k") == 1).alias("n"))
    return (
        one("furniture_chunks", chunks.dropDuplicates(["chunk_id"]).agg(F.count_if(boilerplate_section("section_path")).alias("n"))).unionAll(one("entities_named_once", once))
        .unionAll(one("isolated_documents", isolated.agg(F.count("*").alias("n")))).unionAll(one("undated_documents", documents.agg(F.count_if(F.col("published_at").isNull()).alias("n"))))
    )


def extraction_quality(graded: DataFrame, per_chunk: DataFrame) -> DataFrame:
    """(raw, score, prose_percent): mean chunk quality and the share of prose among graded(kind) sentences."""
    mean = per_chunk.agg(F.avg("quality").alias("raw"))
    prose = graded.agg(F.avg((F.col("kind") == "prose").cast("double")).alias("p"))
    return mean.crossJoin(F.broadcast(prose)).select(F.round(F.coalesce("raw", F.lit(0.0)), 6).alias("raw"), F.round(100 * F.coalesce("raw", F.lit(0.0)), 2).alias("score"), F.round(100 * F.coalesce("p", F.lit(0.0)), 2).alias("prose_percent"))  # one row each


def dating_methods(dated: DataFrame) -> DataFrame:
    """(method, documents): how documents got their date."""
    return dated.groupBy("method").agg(F.count("*").alias("documents"))


def heatmap(chunks: DataFrame, mentions: DataFrame, least: float = 8.0) -> DataFrame:
    """(document_id, density, share): 0.6 per chunk and 0.8 per distinct entity, in percent of the densest, at least ``least``."""
    c = chunks.groupBy("document_id").agg(F.countDistinct("chunk_id").alias("chunks"))
    e = mentions.where("trim(canonical) <> ''").groupBy("document_id").agg(F.countDistinct(F.lower(F.trim("canonical"))).alias("entities"))
    dense = c.join(e, "document_id", "left").select("document_id", F.round(0.6 * F.col("chunks") + 0.8 * F.coalesce("entities", F.lit(0)), 4).alias("density"))
    top = dense.agg(F.max("density").alias("top"))
    return dense.crossJoin(F.broadcast(top)).select("document_id", "density", F.round(F.greatest(F.lit(least), 100 * F.col("density") / F.col("top")), 2).alias("share"))  # one row


def word_cloud(mentions: DataFrame, most: int = 30) -> DataFrame:
    """(canonical, mentions, weight): the most named entities, scaled from 0 to 1."""
    counts = mentions.where("trim(canonical) <> ''").dropDuplicates(["mention_id"]).groupBy(F.lower(F.trim("canonical")).alias("canonical")).agg(F.count("*").alias("mentions"))
    top = counts.orderBy(F.desc("mentions"), "canonical").limit(most)
    whole = W.partitionBy(F.lit(1))
    low, high = F.min("mentions").over(whole), F.max("mentions").over(whole)
    return top.select("canonical", "mentions", F.round(F.when(high > low, (F.col("mentions") - low) / (high - low)).otherwise(1.0), 4).alias("weight"))


def timeline(chunks: DataFrame, buckets: int = 8) -> DataFrame:
    """(bucket, documents, chunks): equal runs of ceil(n / buckets) documents in id order.

    Ranks come from counts per id range, not from one sorted partition of all documents.
    """
    per = chunks.groupBy("document_id").agg(F.countDistinct("chunk_id").alias("chunks"))
    spanned = per.withColumn("span", F.floor(F.col("document_id") / 65536))
    before = spanned.groupBy("span").agg(F.count("*").alias("n")).select("span", (F.sum("n").over(W.orderBy("span")) - F.col("n")).alias("before"), F.sum("n").over(W.partitionBy(F.lit(1))).alias("all"))
    ranked = spanned.join(before, "span").withColumn("r", F.col("before") + F.row_number().over(W.partitionBy("span").orderBy("document_id")) - 1)
    return ranked.groupBy(F.floor(F.col("r") / F.ceil(F.col("all") / buckets)).cast("int").alias("bucket")).agg(F.count("*").alias("documents"), F.sum("chunks").alias("chunks"))
