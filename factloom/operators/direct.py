"""Corpus figures and ranked runs for a set of questions straight from the texts.

A question set names a few thousand terms, while postings grow with the corpus and meet every question that holds a common
word.  Here a task scores its own texts against all questions in matrix products and keeps the k best of each, so that only
term counts and the tasks' best rows are shuffled.  The results are those of the postings.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.operators.lexical import K1, B, table_version
from factloom.session import small, stored

_TOKEN, _WORD = re.compile(rb"[a-z0-9]{2,}"), re.compile(rb"[a-z]{2,}")
_CELLS, _TERMS, _GROUP, _ROWS = 2_000_000, 500_000, 256, 2048

_kept: dict[tuple, object] = {}


def _shared(df: DataFrame, make: Callable, *more: str):
    """What ``make`` gives, once per application and version of the files that a frame reads."""
    key = table_version(df, *more)
    if not key:
        return make()
    if key not in _kept:
        _kept[key] = make()
    return _kept[key]


def once(df: DataFrame, key: str) -> DataFrame:
    """Rows with one of each key, as dropDuplicates; only rows whose key repeats are shuffled."""

    def make() -> DataFrame:
        again = stored(df.groupBy(F.col(key).alias("k")).agg(F.count("*").alias("n")).where("n > 1").select("k"), "repeated-keys")
        if not again.limit(1).count():
            return df
        met = df[key].eqNullSafe(again["k"])
        return df.join(small(again), met, "left_anti").unionByName(df.join(small(again), met, "left_semi").dropDuplicates([key]))

    return _shared(df, make, key, "once")


def token_bytes(text: str | None) -> list[bytes]:
    """The tokens of functions.text.tokens, as bytes; only ASCII letters are lowered."""
    return _TOKEN.findall(text.encode("utf-8", "surrogatepass").lower()) if text else []


def counted(found: list[list[bytes]], place: dict[bytes, int], grow: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, tf) by row and term of the tokens that have a place; with ``grow`` the place is a defaultdict that numbers new ones."""
    ids = [[place[t] for t in ts] for ts in found] if grow else [[place[t] for t in ts if t in place] for ts in found]
    terms = np.fromiter(chain.from_iterable(ids), np.int64)
    rows = np.repeat(np.arange(len(ids)), [len(x) for x in ids])
    wide = max(len(place), 1)
    pairs, tf = np.unique(rows * wide + terms, return_counts=True)
    return pairs // wide, pairs % wide, tf


@dataclass
class Figures:
    """n documents of avgdl tokens on average, terms(term, df, cf) and words(word, n) of letters alone."""

    n: int
    avgdl: float
    terms: DataFrame
    words: DataFrame


def figures(docs: DataFrame, doc: str, text: str = "text") -> Figures:
    """Figures of a corpus in one pass; a task counts in memory and hands on sums.  Words count in rows without an id as well."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def number() -> defaultdict:
            place: defaultdict = defaultdict()
            place.default_factory = place.__len__
            return place

        def flush() -> pd.DataFrame:
            parts = [(1, place, sums[0], sums[1]), (2, words, [0] * len(words), sums[2])]
            out = [pd.DataFrame({"kind": kind, "term": [t.decode() for t in of], "df": np.asarray(a[: len(of)], np.int64), "cf": np.asarray(b[: len(of)], np.int64)}) for kind, of, a, b in parts if of]
            return pd.concat([*out, pd.DataFrame([(0, None, n, length)], columns=["kind", "term", "df", "cf"])])

        def add(to: np.ndarray, more: np.ndarray) -> np.ndarray:
            if len(more) > len(to):
                to = np.concatenate([to, np.zeros(2 * len(more) - len(to), np.int64)])
            to[: len(more)] += more
            return to

        place, words, sums, n, length = number(), number(), [np.zeros(0, np.int64)] * 3, 0, 0
        for b in batches:
            for i in range(0, len(b), _ROWS):
                part = b.iloc[i: i + _ROWS]
                found = [token_bytes(t) for t, ok in zip(part["t"], part["there"]) if ok]
                n, length = n + len(found), length + sum(map(len, found))
                _, terms, tf = counted(found, place, True)
                sums[0], sums[1] = add(sums[0], np.bincount(terms)), add(sums[1], np.bincount(terms, tf).astype(np.int64))
                spelt = [words[w] for t in part["t"] if t for w in _WORD.findall(t.encode("utf-8", "surrogatepass").lower())]
                sums[2] = add(sums[2], np.bincount(np.asarray(spelt, np.int64)))
                if len(place) + len(words) > _TERMS:
                    yield flush()
                    place, words, sums, n, length = number(), number(), [np.zeros(0, np.int64)] * 3, 0, 0
        yield flush()

    rows = once(docs, doc).select(F.col(text).alias("t"), F.col(doc).isNotNull().alias("there")).mapInPandas(run, "kind int, term string, df bigint, cf bigint")
    every = stored(rows.groupBy("kind", "term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf")), "corpus-figures")
    total = every.where("kind = 0").select("df", "cf").first() or (0, 0)
    return Figures(total[0], total[1] / total[0] if total[0] else 0.0, every.where("kind = 1").select("term", "df", "cf"), every.where("kind = 2").select(F.col("term").alias("word"), F.col("cf").alias("n")))


def shared_figures(docs: DataFrame, doc: str, text: str = "text") -> Figures:
    """The figures of a table read from files, counted once per application and version of the files."""
    return _shared(docs, lambda: figures(docs, doc, text), doc, text, "figures")


class _Best:
    """The k greatest scores of each question so far, ties by the smaller document."""

    def __init__(self, run: str, k: int, questions: int):
        self.run, self.k, self.edge, self.rows = run, k, np.zeros(questions), []

    def add(self, first: int, docs: np.ndarray, scores: np.ndarray, found: np.ndarray) -> None:
        at = len(docs) - min(self.k, len(docs))
        edge = np.maximum(np.partition(scores, at, axis=0)[at], self.edge[first: first + scores.shape[1]])
        r, q = np.nonzero((scores >= edge) & found)
        self.rows.append(pd.DataFrame({"q": q + first, "doc": docs[r], "score": scores[r, q]}))

    def prune(self) -> pd.DataFrame:
        if not self.rows:
            return pd.DataFrame({"q": [], "doc": [], "score": []})
        best = pd.concat(self.rows).sort_values(["q", "score", "doc"], ascending=[True, False, True]).groupby("q", sort=False).head(self.k)
        full = best.groupby("q")["score"].agg(["size", "min"])
        full = full[full["size"] == self.k]
        self.edge[full.index.to_numpy(dtype=np.int64)] = full["min"]
        self.rows = [best]
        return best


def direct_runs(docs: DataFrame, doc: str, weighted: DataFrame, of: Figures, k: int, text: str = "text", k1: float = K1, b: float = B) -> DataFrame:
    """(run, query, doc, score), written once, with every row that can be among a query's k best of either run.

    weighted(query, term, weight) is a set of questions.  Run bm25 scores as lexical.bm25 does; run hits counts the query's
    terms in a document.  Questions are scored in groups and texts in batches, so neither bounds the other.
    """
    spark = docs.sparkSession
    asked = weighted.join(of.terms.select("term", "df"), "term").select("query", "term", "weight", "df").collect()  # the question set
    names, queries = sorted({r["term"] for r in asked}), sorted({r["query"] for r in asked})
    place, order = {t.encode(): i for i, t in enumerate(names)}, {q: i for i, q in enumerate(queries)}
    idf = np.zeros(len(names))
    groups: list[list] = [[] for _ in range(0, len(queries), _GROUP)]
    for r in asked:
        t, q = place[r["term"].encode()], order[r["query"]]
        idf[t] = np.log(1 + (of.n - r["df"] + 0.5) / (r["df"] + 0.5))
        groups[q // _GROUP].append((t, q % _GROUP, r["weight"]))
    parts = []
    for g in groups:
        t, q, w = (np.array(x) for x in zip(*g))
        own, at = np.unique(t, return_inverse=True)
        parts.append((own, at, q, w))
    avgdl, step = of.avgdl or 1.0, max(16, min(_ROWS, _CELLS // max(len(names), 1)))
    shared = spark.sparkContext.broadcast((place, idf, parts, queries))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        place, idf, parts, queries = shared.value
        kept = [_Best("bm25", k, len(queries)), _Best("hits", k, len(queries))]
        for batch in batches if queries else ():
            for i in range(0, len(batch), step):
                part = batch.iloc[i: i + step]
                found = [token_bytes(t) for t in part["t"]]
                dl = np.array([len(x) for x in found])
                r, c, tf = counted(found, place)
                m = np.zeros((len(part), len(idf)))
                m[r, c] = idf[c] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl[r] / avgdl))
                ids = part["doc"].to_numpy()
                for g, (own, at, q, w) in enumerate(parts):
                    weights = np.zeros((len(own), q.max() + 1))
                    weights[at, q] = w
                    x = m if len(own) == m.shape[1] else m[:, own]
                    hits = np.rint((x > 0).astype(np.float32) @ (weights > 0).astype(np.float32)).astype(np.float64)
                    kept[0].add(g * _GROUP, ids, np.floor((x @ weights) * 1e6 + 0.5) / 1e6, hits > 0)
                    kept[1].add(g * _GROUP, ids, hits, hits > 0)
            for best in kept:
                best.prune()
        for best in kept:
            if len(rows := best.prune()):
                yield pd.DataFrame({"run": best.run, "query": [queries[int(i)] for i in rows["q"]], "doc": rows["doc"], "score": rows["score"]})

    kind = lambda df, c: df.schema[c].dataType.simpleString()
    texts = once(docs, doc).select(F.col(doc).alias("doc"), F.col(text).alias("t")).where("doc IS NOT NULL")
    return stored(texts.mapInPandas(run, f"run string, query {kind(weighted, 'query')}, doc {kind(docs, doc)}, score double"), "direct-runs")
