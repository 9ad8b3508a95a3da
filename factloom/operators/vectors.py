"""Exact cosine search of a query set against all vectors, block by block."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BLOCK = 4096


def _blocks(df: DataFrame, key: str, vector: str, name: str) -> DataFrame:
    """(name_ids, name_vecs): blocks of at most BLOCK unit vectors packed as bytes."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b = b[b["v"].notna()]
            for i in range(0, len(b), BLOCK):
                part = b.iloc[i: i + BLOCK]
                m = np.stack([np.asarray(v, dtype=np.float64) for v in part["v"]])
                norm = np.linalg.norm(m, axis=1)
                keep = norm > 0
                yield pd.DataFrame({f"{name}_ids": [part["k"].to_numpy(np.int64)[keep].tobytes()], f"{name}_vecs": [(m[keep] / norm[keep, None]).tobytes()]})

    return df.select(F.col(key).cast("bigint").alias("k"), F.col(vector).alias("v")).where("k IS NOT NULL").mapInPandas(pack, f"{name}_ids binary, {name}_vecs binary")


def cosine_top_k(vectors: DataFrame, queries: DataFrame, key: str, vector: str, k: int = 10) -> DataFrame:
    """(query, doc, score, rank): for each query vector its k most similar other vectors, exactly.

    Blocks of queries meet blocks of vectors in one matrix product each; k partial results per block and query are
    merged by a window.  Null and zero vectors match nothing; ties go to the smaller id.
    """
    q, v = _blocks(queries, key, vector, "q"), _blocks(vectors, key, vector, "v")

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for qi, qv, vi, vv in zip(b["q_ids"], b["q_vecs"], b["v_ids"], b["v_vecs"]):
                qs, vs = np.frombuffer(qi, np.int64), np.frombuffer(vi, np.int64)
                if not len(qs) or not len(vs):
                    continue
                s = np.frombuffer(qv).reshape(len(qs), -1) @ np.frombuffer(vv).reshape(len(vs), -1).T
                s[qs[:, None] == vs[None, :]] = -np.inf
                s = np.round(s, 6)
                n = min(k, len(vs))
                edge = -np.partition(-s, n - 1, axis=1)[:, n - 1: n]
                rows, cols = np.nonzero((s >= edge) & np.isfinite(s))  # ties at the edge stay for the merge
                yield pd.DataFrame({"query": qs[rows], "doc": vs[cols], "score": s[rows, cols]})

    found = q.crossJoin(v).mapInPandas(score, "query bigint, doc bigint, score double")  # a stated query set against all rows, in blocks
    order = W.partitionBy("query").orderBy(F.desc("score"), "doc")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
