"""Retrieval quality against gold judgements, per mode and category, and the release gate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Least recall@5 and mean reciprocal rank a release needs.
GATES = {"recall_5": 0.70, "mrr": 0.55}


def case_metrics(ranked: DataFrame, gold: DataFrame) -> DataFrame:
    """ranked(mode, query, doc, rank) and gold(query, doc) to one row per mode and case.

    recall_5 and recall_10 ask for any relevant document, mrr takes the first, ndcg_10 divides by the ideal order of the
    relevant documents retrieved.  A case without a hit scores 0 in all of them.
    """
    modes = ranked.select("mode").distinct()
    hits = ranked.where("rank <= 10").join(gold, ["query", "doc"])
    per = hits.groupBy("mode", "query").agg(F.min("rank").alias("first"), F.count("*").alias("k"), F.sum(1 / F.log2(F.col("rank") + 1)).alias("dcg"))
    cases = gold.select("query").distinct().crossJoin(F.broadcast(modes))  # one row per mode
    ideal = F.aggregate(F.sequence(F.lit(1), F.col("k").cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return cases.join(per, ["mode", "query"], "left").select(
        "mode", "query", (F.coalesce("first", F.lit(99)) <= 5).cast("double").alias("recall_5"), (F.coalesce("first", F.lit(99)) <= 10).cast("double").alias("recall_10"),
        zero(F.round(1 / F.col("first"), 6)).alias("mrr"), zero(F.round(F.col("dcg") / F.when(F.col("k") > 0, ideal), 6)).alias("ndcg_10"))


def mean_metrics(cases: DataFrame, by: list[str]) -> DataFrame:
    return cases.groupBy(*by).agg(*[F.round(F.avg(c), 6).alias(c) for c in ("recall_5", "recall_10", "mrr", "ndcg_10")], F.count("*").alias("cases"))


def gate(means: DataFrame, mode: str, gates: dict[str, float] = GATES) -> DataFrame:
    """(metric, value, needed, passed) of one mode."""
    rows = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value"), F.lit(float(v)).alias("needed"), (F.col(m) >= v).alias("passed")) for m, v in gates.items()])
    return means.where(F.col("mode") == mode).select(F.inline(rows))


def matcher_hits(ranked: DataFrame, chunks: DataFrame, matchers: DataFrame, depth: int = 10) -> DataFrame:
    """(query, matcher, rank): which of a case's matchers each ranked chunk meets.

    ranked(query, doc, rank), chunks(doc, text, fields MAP), matchers(query, matcher, field, wanted ARRAY), a few per
    case.  Field text_contains asks for any of the strings within the text, another field for equality with one; case
    is ignored.  Chunks meet only their own case's matchers, in an equi-join on the case.
    """
    top = ranked.where(F.col("rank") <= depth).join(chunks, "doc")
    low = F.lower(F.coalesce("text", F.lit("")))
    inside = F.exists("wanted", lambda w: low.contains(F.lower(w)))
    same = F.exists("wanted", lambda w: F.lower(F.col("fields")[F.col("field")]) == F.lower(w))
    fits = F.when(F.col("field") == "text_contains", inside).otherwise(same)
    return top.join(matchers, "query").where(F.coalesce(fits, F.lit(False))).groupBy("query", "matcher", "doc").agg(F.min("rank").alias("rank")).select("query", "matcher", "rank").distinct()


def scored_cases(ranked: DataFrame, hits: DataFrame, cases: DataFrame, least: int = 3) -> DataFrame:
    """One row per case: recall_5, recall_10, mrr, ndcg_10, hits, cross_source_satisfied and robustness.

    cases(query, kind, matchers): kind any (one relevant chunk is enough), all (each of the ``matchers`` matchers is to be
    met within ten) or low (at most ``least`` results are right).  Fields a kind does not know are null and enter no mean.
    """
    met = hits.groupBy("query").agg(F.countDistinct("matcher").alias("met"), F.min("rank").alias("first"), F.array_sort(F.collect_set("rank")).alias("ranks"))
    shown = ranked.where("rank <= 10").groupBy("query").agg(F.count("*").alias("hits"))
    row = cases.join(met, "query", "left").join(shown, "query", "left").withColumns({"hits": F.coalesce("hits", F.lit(0)), "met": F.coalesce("met", F.lit(0))})
    gain = lambda ranks: F.aggregate(ranks, F.lit(0.0), lambda a, r: a + 1 / F.log2(r + 1))
    any_10, any_5 = F.col("first").isNotNull().cast("double"), (F.coalesce("first", F.lit(99)) <= 5).cast("double")
    share, every = F.col("met") / F.greatest("matchers", F.lit(1)), (F.col("met") >= F.col("matchers")).cast("double")
    low = (F.col("hits") <= least).cast("double")
    ideal = F.transform(F.sequence(F.lit(1), F.greatest(F.size(F.coalesce("ranks", F.array().cast("array<int>"))), F.lit(1))), lambda i: i)
    ndcg = F.when(F.col("first").isNull(), 0.0).otherwise(gain(F.col("ranks")) / gain(ideal))
    pick = lambda a, b, c: F.round(F.when(F.col("kind") == "low", a).when(F.col("kind") == "all", b).otherwise(c), 6)
    return row.select(
        "query", "kind", pick(low, share, any_5).alias("recall_5"), pick(low, share, any_10).alias("recall_10"), pick(low, every, F.coalesce(1 / F.col("first"), F.lit(0.0))).alias("mrr"),
        pick(low, share, ndcg).alias("ndcg_10"), "hits", F.when(F.col("kind") == "all", every == 1).alias("cross_source_satisfied"), F.when(F.col("kind") == "low", low == 1).alias("robustness"))


def uplift(means: DataFrame, mode: str = "hybrid", over: str = "lexical") -> DataFrame:
    """(metric, delta, percent): what one mode gains over another in recall_10."""
    of = lambda m: F.max(F.when(F.col("mode") == m, F.col("recall_10")))
    two = means.agg(of(mode).alias("a"), of(over).alias("b"))
    return two.select(F.lit("recall_10").alias("metric"), F.round(F.col("a") - F.col("b"), 6).alias("delta"), F.round(F.coalesce(F.try_divide(100 * (F.col("a") - F.col("b")), F.col("b")), F.lit(0.0)), 4).alias("percent"))


def weak_cases(cases: DataFrame, mode: str = "hybrid") -> DataFrame:
    """Cases of a mode that miss full recall at ten, least first."""
    return cases.where((F.col("mode") == mode) & (F.col("recall_10") < 1)).select("query", "recall_10")
