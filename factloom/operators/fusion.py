"""Fusion of ranked runs, facets after ranking, and retrieval diagnostics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def reciprocal_rank_fusion(runs: DataFrame, k: int = 60, depth: int = 40) -> DataFrame:
    """runs(query, retriever, doc, score, rank, weight) to (query, doc, score, retrievers, ranks).

    A full outer merge as one union and one group: each run adds weight / (k + rank).
    """
    used = runs.where(F.col("rank") <= depth)
    return used.groupBy("query", "doc").agg(
        F.round(F.sum(F.col("weight") / (k + F.col("rank"))), 9).alias("score"),
        F.array_join(F.array_sort(F.collect_set("retriever")), "+").alias("retrievers"),  # one entry per retriever
        F.min("rank").alias("best_rank"),
    )


def faceted(ranked: DataFrame, docs: DataFrame, doc: str, wanted: dict[str, str]) -> DataFrame:
    """Conjunctive equality on document columns, applied after ranking; null or 'all' is no filter."""
    on = {c: v for c, v in wanted.items() if v not in (None, "all")}
    kept = docs.select(F.col(doc).alias("doc"), *on).where(F.lit(True))
    for c, v in on.items():
        kept = kept.where(F.col(c).cast("string") == v)
    return ranked.join(kept.select("doc").distinct(), "doc", "left_semi")


def facet_counts(docs: DataFrame, dimensions: list[str], most: int = 60) -> DataFrame:
    """(dimension, value, n): the most frequent values of each dimension, blanks left out; one pass over the rows."""
    long = docs.select(F.inline(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value")) for d in dimensions]))).where("value IS NOT NULL AND value <> ''")
    counts = long.groupBy("dimension", "value").agg(F.count("*").alias("n"))
    order = W.partitionBy("dimension").orderBy(F.desc("n"), "value")
    return counts.withColumn("r", F.row_number().over(order)).where(F.col("r") <= most).drop("r")


def diagnostics(lexical: DataFrame, second: DataFrame, k: int = 10) -> DataFrame:
    """Per query: agreement (Jaccard of the two top k, 2 dp) and margin of the lexical run.

    The margin is the top score less the mean of the next four, over the top score.
    """
    both = lexical.where(F.col("rank") <= k).select("query", "doc", F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(second.where(F.col("rank") <= k).select("query", "doc", F.lit(0).alias("a"), F.lit(1).alias("b")))
    each = both.groupBy("query", "doc").agg(F.max("a").alias("a"), F.max("b").alias("b"))
    agree = each.groupBy("query").agg(F.round(F.sum(F.col("a") * F.col("b")) / F.count("*"), 2).alias("agreement"))
    top = lexical.where("rank <= 5").groupBy("query").agg(F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("top"), F.avg(F.when(F.col("rank") > 1, F.col("score"))).alias("rest"))
    return agree.join(top, "query", "left").select("query", "agreement", F.round(F.coalesce(F.try_divide(F.col("top") - F.col("rest"), F.col("top")), F.lit(0.6)), 4).alias("margin"))


def explained(runs: DataFrame, k: int = 60, depth: int = 40) -> DataFrame:
    """(query, doc, score, ranks, contributions, explanation): what each retriever added to a fused score.

    ranks and contributions are maps by retriever; the explanation lists the retrievers in name order.
    """
    used = runs.where(F.col("rank") <= depth).withColumn("part", F.round(F.col("weight") / (k + F.col("rank")), 6))
    parts = F.array_sort(F.collect_list(F.struct("retriever", "rank", "part")))  # one entry per retriever
    every = used.groupBy("query", "doc").agg(F.round(F.sum(F.col("weight") / (k + F.col("rank"))), 9).alias("score"), parts.alias("parts"))
    said = F.transform("parts", lambda x: F.concat(x["retriever"], F.lit(" #"), x["rank"].cast("string"), F.lit(" (+"), F.format_number(x["part"], 6), F.lit(")")))
    return every.select(
        "query", "doc", "score", F.map_from_entries(F.transform("parts", lambda x: F.struct(x["retriever"], x["rank"]))).alias("ranks"),
        F.map_from_entries(F.transform("parts", lambda x: F.struct(x["retriever"], x["part"]))).alias("contributions"), F.array_join(said, ", ").alias("explanation"))
