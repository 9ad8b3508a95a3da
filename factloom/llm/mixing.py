"""Mixing sources to target weights (problem 9).

Documents are counted by exact token length per source.  A source's budget is met by uses of whole documents, each
used up to the repeat cap, spread evenly over all lengths; a bounded-knapsack program over the length counts fits
the rest, which hits the budget to the token wherever the lengths allow it.  Which documents of a length
are used once more is decided by a seeded hash.  Only length histograms reach the driver.
"""

from __future__ import annotations

import base64
import random
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factloom.session import stored

#: Longest token length that takes part in the exact step, which keeps its tables within a few million sums.
EXACT_LENGTH = 1_000_000


@lru_cache(2)
def _encoding(ranks: bytes, pattern: str):
    import tiktoken

    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines()) if a}
    return tiktoken.Encoding("mixing", pat_str=pattern, mergeable_ranks=table, special_tokens={})


def token_lengths(df: DataFrame, doc_id: str, source: str, text: str, vocabulary: str, pattern: str) -> DataFrame:
    """(doc, source, tokens): size of each distinct document under a byte-level BPE vocabulary file.

    Sources are trimmed and lower-cased; a null text has no tokens.
    """
    with open(vocabulary, "rb") as f:
        ranks = df.sparkSession.sparkContext.broadcast(f.read())  # one fixed vocabulary file

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = _encoding(ranks.value, pattern)
        for b in batches:
            yield pd.DataFrame({"doc": b["doc"], "source": b["source"], "tokens": [len(enc.encode_ordinary(t)) if t else 0 for t in b["t"]]})

    docs = df.select(F.col(doc_id).alias("doc"), F.lower(F.trim(F.col(source))).alias("source"), F.col(text).alias("t")).where("doc IS NOT NULL AND source IS NOT NULL")
    return docs.mapInPandas(count, f"doc {df.schema[doc_id].dataType.simpleString()}, source string, tokens bigint").distinct()


def subset_sum(sizes: dict[int, int], target: int, at_least: bool = False) -> dict[int, int]:
    """Bounded knapsack: counts of each size, at most as given, whose sum comes closest to the target.

    From below, or from above with ``at_least`` (then everything, if even that is less).  Each sum remembers the first
    step that reached it, which is all that is needed to read the choice back.
    """
    top = target + (max(sizes, default=0) if at_least else 0)
    reach, first, steps = np.zeros(top + 1, dtype=bool), np.full(top + 1, -1, dtype=np.int32), []
    reach[0] = True
    for n, count in sizes.items():
        left, part = min(count, top // n), 1
        while left > 0 and not reach[target]:
            w = n * (k := min(part, left))
            new = reach[:-w] & ~reach[w:]
            first[w:][new] = len(steps)
            reach[w:] |= new
            steps.append((n, k))
            left, part = left - k, part * 2
    above = np.flatnonzero(reach[target:])
    if at_least and not len(above):
        return dict(sizes)
    s, out = (target + int(above[0]) if at_least else int(np.flatnonzero(reach[: target + 1])[-1])), {}
    while s > 0:
        n, k = steps[first[s]]
        out[n] = out.get(n, 0) + k
        s -= n * k
    return out


def fit_budget(histogram: dict[int, int], budget: int, most: int = 1, seed: int = 0, longest: int = EXACT_LENGTH) -> dict[int, int]:
    """How often documents of each length are used so that their tokens come closest to the budget from below.

    A document may be used ``most`` times.  Uses are even over the lengths first, then single ones follow in seeded order
    while more than a window of four longest lengths is missing; the bounded knapsack fits what is left.  Near
    the source's whole capacity it fits what to leave out instead.  Both are exact where budget or rest lie within a window; in
    between every length has uses to spare on both sides.  Lengths beyond ``longest`` are placed before the exact step only.
    """
    sizes = {n: c * most for n, c in histogram.items() if n > 0 and c > 0 and most > 0}
    whole = sum(n * c for n, c in sizes.items())
    if budget >= whole:
        return sizes
    order = sorted(sizes)
    random.Random(seed).shuffle(order)
    short = [n for n in order if n <= longest]
    window = 4 * max(short, default=0)
    if whole - budget <= window and len(short) == len(order):
        gone = subset_sum({n: sizes[n] for n in order}, whole - budget, at_least=True)
        return {n: c - gone.get(n, 0) for n, c in sizes.items() if c > gone.get(n, 0)}
    take = {n: c * max(budget - window, 0) // whole for n, c in sizes.items()}
    rest = budget - sum(n * c for n, c in take.items())
    for n in [*(n for n in order if n > longest), *short]:
        room = rest - (window if n <= longest else 0)
        if room > 0:
            more = min(sizes[n] - take[n], room // n)
            take[n] += more
            rest -= n * more
    for n in short:
        if rest <= window:
            break
        more = min(sizes[n] - take[n], -(-(rest - window) // n))
        take[n] += more
        rest -= n * more
    for n, k in subset_sum({n: sizes[n] - take[n] for n in short}, rest).items():
        take[n] += k
    return {n: c for n, c in take.items() if c}


def plan_mixture(histograms: dict[str, dict[int, int]], targets: dict[str, tuple[float, int]], total: int | None = None, seed: int = 0) -> list[dict]:
    """Per target source: its budget and how often documents of each length are used.

    Shares are normalised over the sources that hold tokens and may be used.  Without ``total`` the mixture is
    the largest in which each of them reaches its share; with it, a source too small for its budget
    gives all it may and is reported short.
    """
    tokens = {s: sum(n * c for n, c in histograms.get(s, {}).items()) for s in targets}
    usable = {s: share for s, (share, most) in targets.items() if share > 0 and tokens[s] * max(most, 0) > 0}
    norm = sum(usable.values())
    if total is None:
        total = min((tokens[s] * targets[s][1] * norm / share for s, share in usable.items()), default=0)
    plans = []
    for s in sorted(targets):
        share, most = targets[s]
        budget = int(total * usable[s] / norm + 1e-4) if s in usable else 0
        uses = fit_budget(histograms.get(s, {}), budget, most, seed) if s in usable else {}
        plans.append({"source": s, "target_share": share, "max_repeats": most, "source_tokens": tokens[s], "budget": budget, "uses": uses})
    return plans


def mixture(docs: DataFrame, targets: DataFrame, doc_id: str = "doc_id", total: int | None = None, seed: int = 0, *, source: str = "source", text: str = "text",
            vocabulary: str, pattern: str) -> tuple[DataFrame, DataFrame]:
    """(mixture, shares): each chosen document with its copies, and what every source reached.

    mixture: doc_id, source, tokens, copies (1 to max_repeats).  shares: source, target_share, max_repeats,
    source_documents, source_tokens, budget, mixed_tokens, copies, actual_share, status (reached, short, no documents).
    Target rows that repeat count once, rows of one source that differ are added up; null sources and shares are ignored.
    Null or empty texts have no tokens and are never chosen; documents of other sources are left out; empty
    documents or targets give an empty mixture.
    """
    sized = stored(token_lengths(docs, doc_id, source, text, vocabulary, pattern), "mix-lengths")
    wanted = {
        r["s"]: (r["share"], r["most"] or 0)
        for r in targets.distinct().where("source IS NOT NULL AND target_share IS NOT NULL").groupBy(F.lower(F.trim("source")).alias("s"))
        .agg(F.sum("target_share").alias("share"), F.max("max_repeats").alias("most")).collect()  # the list of target sources
    }
    listed = sized.where(F.col("source").isin(list(wanted)) & (F.col("tokens") > 0))
    histograms: dict[str, dict[int, int]] = {}
    for r in listed.groupBy("source", "tokens").agg(F.count("*").alias("n")).toLocalIterator():
        histograms.setdefault(r["source"], {})[r["tokens"]] = r["n"]
    plans = plan_mixture(histograms, wanted, total, seed)
    spark = docs.sparkSession
    used = [(p["source"], n, *divmod(c, histograms[p["source"]][n])) for p in plans for n, c in p["uses"].items()]
    uses = spark.createDataFrame(used, "source string, tokens bigint, each bigint, more bigint")
    # the first ``more`` documents of a (source, length) by seeded hash; ranked in hash slices, so that
    # one length may hold any share of the rows
    h = F.xxhash64(F.lit(seed), "doc")
    sliced = listed.select("doc", "source", "tokens", h.alias("h"), F.shiftrightunsigned(h, 54).alias("slice"))
    per = ["source", "tokens"]
    counts = sliced.groupBy(*per, "slice").agg(F.count("*").alias("n"))
    before = counts.select(*per, "slice", F.coalesce(F.sum("n").over(W.partitionBy(*per).orderBy("slice").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    ranked = (
        sliced.join(before, [*per, "slice"]).withColumn("rank", F.col("before") + F.row_number().over(W.partitionBy(*per, "slice").orderBy("h", "doc")))
        .join(uses, per)
    )
    copies = F.col("each") + F.when(F.col("rank") <= F.col("more"), 1).otherwise(0)
    chosen = stored(ranked.select(F.col("doc").alias(doc_id), "source", "tokens", copies.cast("int").alias("copies")).where("copies > 0"), "mix-chosen")
    got = chosen.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("mixed_tokens"), F.sum("copies").alias("copies"))
    whole = got.agg(F.sum("mixed_tokens").alias("whole"))
    base = spark.createDataFrame(
        [(p["source"], float(p["target_share"]), int(p["max_repeats"]), sum(histograms.get(p["source"], {}).values()), p["source_tokens"], p["budget"]) for p in plans],
        "source string, target_share double, max_repeats int, source_documents bigint, source_tokens bigint, budget bigint")
    shares = (
        base.join(got, "source", "left").crossJoin(F.broadcast(whole))  # one row
        .select(*base.columns, F.coalesce("mixed_tokens", F.lit(0)).alias("mixed_tokens"), F.coalesce("copies", F.lit(0)).alias("copies"),
                F.round(F.coalesce(F.col("mixed_tokens") / F.col("whole"), F.lit(0.0)), 6).alias("actual_share"),
                F.when(F.col("source_tokens") == 0, "no documents").when(F.coalesce("mixed_tokens", F.lit(0)) < F.col("budget") * 0.999, "short").otherwise("reached").alias("status"))
    )
    return chosen, shares
