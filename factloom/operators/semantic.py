"""Latent semantic index: TF-IDF and a randomized truncated SVD as Spark passes over the documents.

The term side is bounded (``most_terms``), so the iterated basis is a small matrix that every task
holds; the document side never leaves the executors.  Each power iteration is one pass: a task
multiplies its packed rows with the basis and back and emits its partial sum in term blocks,
which are added per block before the driver sees them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions import lexicons as L
from factloom.operators.direct import counted, once, shared_figures, token_bytes
from factloom.operators.lexical import table_version, top_k
from factloom.session import small, stored

_BLOCK, _HOT = 512, 768


@dataclass
class SemanticIndex:
    """terms with idf, unit term vectors on the driver, and how vectors(doc, vector) are made; disabled with a reason."""

    enabled: bool
    reason: str = ""
    terms: dict[str, int] = field(default_factory=dict)
    idf: np.ndarray | None = None
    term_vectors: np.ndarray | None = None
    make_vectors: Callable[[], DataFrame] | None = None
    _vectors: DataFrame | None = None

    @property
    def vectors(self) -> DataFrame:
        """(doc, vector) of the documents, projected and written when first asked for."""
        if self._vectors is None:
            self._vectors = self.make_vectors()
        return self._vectors

    def embed(self, text: str) -> list[float] | None:
        """Unit vector of a query, or None if no term is known; repeated terms count again."""
        import re

        known = [self.terms[t.lower()] for t in re.findall("[A-Za-z0-9]{2,}", text or "") if t.lower() in self.terms] if self.enabled else []
        if not known:
            return None
        v = (self.idf[known, None] * self.term_vectors[known]).sum(axis=0)
        n = float(np.linalg.norm(v))
        return (v / n).tolist() if n > 0 else None


def quantize(m: np.ndarray) -> tuple[np.ndarray, float]:
    """int8 form of a matrix and the scale that restores it."""
    top = float(np.abs(m).max()) if m.size else 0.0
    scale = top / 127 if top > 0 else 1.0
    return np.clip(np.rint(m / scale), -127, 127).astype(np.int8), scale


def build_semantic(docs: DataFrame, doc: str, text: str = "text", dims: int = 96, most_terms: int = 6000, seed: int = 42, passes: int = 3, stop: list[str] = L.FUNCTION_WORDS) -> SemanticIndex:
    """Index of docs; fewer than 3 texts, 4 terms or 2 dimensions disable it with a reason.

    Terms occur in 2 documents or more (1 below 50 documents); the ``most_terms`` most frequent are kept, ties in term order.
    Weights are (1 + ln tf) (ln((1 + n) / (1 + df)) + 1), rows have unit length.
    """
    corpus = shared_figures(docs, doc, text)
    n = corpus.n
    if n < 3:
        return SemanticIndex(False, "fewer than 3 texts")
    kept = corpus.terms.where((F.col("df") >= (1 if n < 50 else 2)) & ~F.col("term").isin(*stop)).orderBy(F.desc("cf"), "term").limit(most_terms).collect()  # bounded by most_terms
    if len(kept) < 4:
        return SemanticIndex(False, "fewer than 4 terms")
    k = min(dims, len(kept) - 1, n - 1)
    if k < 2:
        return SemanticIndex(False, "fewer than 2 dimensions")
    names = sorted(r["term"] for r in kept)
    place = {t: i for i, t in enumerate(names)}
    df = {r["term"]: r["df"] for r in kept}
    idf = np.array([np.log((1 + n) / (1 + df[t])) + 1 for t in names])
    spark = docs.sparkSession
    rows = _blocks(docs, doc, text, place)
    width = k + 10
    hot = np.argsort([-df[t] for t in names], kind="stable")[:_HOT]
    basis = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(names), min(width, len(names)))))[0]
    for _ in range(passes):
        basis = np.linalg.qr(_normal_product(rows, basis, idf, hot))[0]
    # Rayleigh-Ritz step on the small side
    small_gram = basis.T @ _normal_product(rows, basis, idf, hot)
    values, rotate = np.linalg.eigh((small_gram + small_gram.T) / 2)
    order = np.argsort(values)[::-1][:k]
    right = basis @ rotate[:, order]
    singular = np.sqrt(np.maximum(values[order], 0))
    term_vectors = right * singular
    length = np.linalg.norm(term_vectors, axis=1, keepdims=True)
    term_vectors = term_vectors / np.where(length > 0, length, 1)

    def projected() -> DataFrame:
        shared = spark.sparkContext.broadcast((right, idf))

        def project(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            right, idf = shared.value
            for b in batches:
                for ids, *block in zip(b["docs"], b["starts"], b["i"], b["tf"]):
                    starts, i, w, _ = _weighted(*block, idf)
                    v = np.add.reduceat(right[i] * w[:, None], starts)
                    size = np.linalg.norm(v, axis=1, keepdims=True)
                    yield pd.DataFrame({"doc": ids, "vector": list(v / np.where(size > 0, size, 1))})

        return stored(rows.mapInPandas(project, f"doc {docs.schema[doc].dataType.simpleString()}, vector array<double>"), "lsa-vectors")

    return SemanticIndex(True, "", place, idf, term_vectors, make_vectors=projected)


def _blocks(docs: DataFrame, doc: str, text: str, place: dict[str, int]) -> DataFrame:
    """(docs, starts, i, tf), written once: texts by the block, packed; the terms of the j-th begin at starts[j].  Texts without a term are left out."""
    shared = docs.sparkSession.sparkContext.broadcast({t.encode(): i for t, i in place.items()})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), _BLOCK):
                part = b.iloc[at: at + _BLOCK]
                r, i, tf = counted([token_bytes(t) for t in part["t"]], shared.value)
                held, starts = np.unique(r, return_index=True)
                if len(held):
                    yield pd.DataFrame({"docs": [part["doc"].to_numpy()[held]], "starts": [starts.astype(np.int32).tobytes()], "i": [i.astype(np.int32).tobytes()], "tf": [tf.astype(np.int32).tobytes()]})

    kind = docs.schema[doc].dataType.simpleString()
    texts = once(docs, doc).select(F.col(doc).alias("doc"), F.col(text).alias("t")).where("doc IS NOT NULL")
    return stored(texts.mapInPandas(run, f"docs array<{kind}>, starts binary, i binary, tf binary"), "lsa-rows")


def _weighted(starts: bytes, i: bytes, tf: bytes, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(starts, terms, weights, rows) of a block; each row has unit length."""
    at, terms = np.frombuffer(starts, np.int32), np.frombuffer(i, np.int32)
    w = (1 + np.log(np.frombuffer(tf, np.int32))) * idf[terms]
    rows = np.repeat(np.arange(len(at)), np.diff(at, append=len(terms)))
    return at, terms, w / np.sqrt(np.add.reduceat(w * w, at))[rows], rows


def _normal_product(rows: DataFrame, basis: np.ndarray, idf: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """transpose(A) A basis for the unit-length sparse rows A: one pass, partial sums added per term block.

    The most frequent terms (``hot``), which hold most of the entries, are multiplied as a dense part of each block, the others one by one.
    """
    context = rows.sparkSession.sparkContext
    shared = context.broadcast((basis, idf, hot))
    terms, width = basis.shape

    def summed(to: np.ndarray, at: np.ndarray, values: np.ndarray) -> None:
        first = np.flatnonzero(np.diff(at, prepend=-1))
        to[at[first]] += np.add.reduceat(values, first)

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        basis, idf, hot = shared.value
        column, total = np.full(terms, -1), np.zeros((terms, width))
        column[hot] = np.arange(len(hot))
        for b in batches:
            for block in zip(b["starts"], b["i"], b["tf"]):
                starts, i, w, r = _weighted(*block, idf)
                often = column[i] >= 0
                dense = np.zeros((len(starts), len(hot)))
                dense[r[often], column[i[often]]] = w[often]
                there = dense @ basis[hot]
                i, w, r = i[~often], w[~often], r[~often]
                if len(i):
                    summed(there, r, basis[i] * w[:, None])
                    order = np.argsort(i, kind="stable")
                    summed(total, i[order], there[r[order]] * w[order, None])
                total[hot] += dense.T @ there
        starts = range(0, terms, _BLOCK)
        yield pd.DataFrame({"block": list(starts), "m": [total[s: s + _BLOCK].tobytes() for s in starts]})

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        m = np.zeros(len(np.frombuffer(pdf["m"].iloc[0])))
        for x in pdf["m"]:
            m += np.frombuffer(x)
        return pd.DataFrame({"block": [pdf["block"].iloc[0]], "m": [m.tobytes()]})

    out = np.zeros((terms, width))
    few = rows.select("starts", "i", "tf").coalesce(2 * context.defaultParallelism)  # a task's sum is as large as the basis
    for r in few.mapInPandas(part, "block int, m binary").groupBy("block").applyInPandas(add, "block int, m binary").toLocalIterator():
        m = np.frombuffer(r["m"]).reshape(-1, width)
        out[r["block"]: r["block"] + len(m)] = m
    shared.destroy()
    return out


def semantic_search(index: SemanticIndex, queries: list[tuple], k: int = 10, floor: float = 0.01) -> DataFrame:
    """(query, doc, score, rank) for a list of (id, text): cosine above the floor, one matrix product per batch."""
    embedded = [(q, v) for q, t in queries if (v := index.embed(t)) is not None]
    spark = index.vectors.sparkSession
    kind = index.vectors.schema["doc"].dataType.simpleString()
    if not embedded:
        return spark.createDataFrame([], f"query bigint, doc {kind}, score double, rank int")
    ids, m = [q for q, _ in embedded], np.array([v for _, v in embedded])
    shared = spark.sparkContext.broadcast((ids, m))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, q = shared.value
        for b in batches:
            s = np.round(q @ np.stack(b["vector"]).T, 6)
            edge = -np.partition(-s, min(k, s.shape[1]) - 1, axis=1)[:, min(k, s.shape[1]) - 1: min(k, s.shape[1])]
            r, c = np.nonzero((s >= edge) & (s > floor))
            yield pd.DataFrame({"query": [names[i] for i in r], "doc": b["doc"].to_numpy()[c], "score": s[r, c]})

    return top_k(index.vectors.mapInPandas(score, f"query bigint, doc {kind}, score double"), k)


def embedded(questions: DataFrame, index: SemanticIndex) -> DataFrame:
    """questions(query, text) with asked: the unit vector of each, null where no term is known."""
    shared = questions.sparkSession.sparkContext.broadcast(replace(index, make_vectors=None, _vectors=None))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"query": b["query"], "asked": [shared.value.embed(t) for t in b["text"]]})

    return questions.select("query", "text").mapInPandas(run, f"query {questions.schema['query'].dataType.simpleString()}, asked array<double>")


def with_similarity(pairs: DataFrame, index: SemanticIndex, questions: DataFrame, text: str = "sentence") -> DataFrame:
    """pairs(query, text, ...) with semantic: cosine of the text and its question's text, at least 0; 0 where either has no known term.

    questions(query, text) are embedded where they are and joined; nothing is gathered.
    """
    shared = pairs.sparkSession.sparkContext.broadcast(replace(index, make_vectors=None, _vectors=None))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            own = {t: shared.value.embed(t) for t in b[text].unique()}
            near = [max(0.0, float(np.dot(a, own[t]))) if a is not None and own[t] is not None else 0.0 for a, t in zip(b["asked"], b[text])]
            yield b.drop(columns="asked").assign(semantic=near)

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pairs.schema)
    met = pairs.join(small(embedded(questions, index)), "query", "left").select(*pairs.columns, "asked")
    return met.mapInPandas(run, f"{schema}, semantic double")


_indexes: dict[tuple, SemanticIndex] = {}


def shared_semantic(docs: DataFrame, doc: str, text: str = "text") -> SemanticIndex:
    """The index of a table read from files, built once per application and version of the files."""
    key = table_version(docs, doc, text)
    if not key or key not in _indexes:
        index = build_semantic(docs, doc, text)
        if not key:
            return index
        _indexes[key] = index
    return _indexes[key]
