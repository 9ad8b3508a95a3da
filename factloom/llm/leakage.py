"""Evaluation texts inside training text (problem 8).

Multi-pattern search after Wu and Manber over words: the patterns are all windows of ``width``
consecutive words of the evaluation items (shipped in parts of checked size).  A block is two words.  A
shift table says how far the search window may move when the block under its end ends no pattern;
where a block may end a pattern, a bucket keyed by it lists the patterns to compare directly.
Texts are searched whole, in Arrow batches next to the scan, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pattern words whose tables are shipped to tasks at once, as they must stay resident; more are searched in parts.
PART_WORDS = 5_000_000

_WORD = regex.compile(r"[\p{L}\p{N}]+")


def words(text: str) -> list[str]:
    """Maximal runs of letters and digits, lower-cased."""
    return _WORD.findall(text.lower())


class WuManber:
    """Shift and bucket tables for word patterns of one width."""

    def __init__(self, items: list[tuple[int, str]], width: int):
        self.width = width
        self.shift: dict[tuple[str, str], int] = {}
        self.bucket: dict[tuple[str, str], dict[tuple[str, ...], set[int]]] = {}
        for item, text in items:
            w = words(text or "")
            for i in range(len(w) - width + 1):
                p = tuple(w[i: i + width])
                for j in range(width - 1):
                    block, move = (p[j], p[j + 1]), width - 2 - j
                    if move < self.shift.get(block, width - 1):
                        self.shift[block] = move
                self.bucket.setdefault((p[-2], p[-1]), {}).setdefault(p, set()).add(item)

    def search(self, text: str) -> set[int]:
        """Items of which at least ``width`` consecutive words occur in the text."""
        found: set[int] = set()
        if not text:
            return found
        w, m, far = words(text), self.width, self.width - 1
        shift, bucket, end, n = self.shift.get, self.bucket, self.width - 1, 0
        n = len(w)
        while end < n:
            block = (w[end - 1], w[end])
            move = shift(block, far)
            if move:
                end += move
                continue
            hit = bucket[block].get(tuple(w[end - m + 1: end + 1]))
            if hit:
                found |= hit
            end += 1
        return found


def leaked_items(docs: DataFrame, items: DataFrame, doc_id: str, item_id: str, width: int = 12, text: str = "text", item_text: str = "text", part_words: int = PART_WORDS) -> DataFrame:
    """Distinct (item_id, doc_id) where the document holds ``width`` consecutive words of the item.

    Items shorter than ``width`` words, and null or empty texts on either side, match nothing.
    Ties and repeated rows collapse; empty tables give an empty result; other columns are ignored.
    """
    size = items.agg(F.coalesce(F.sum(F.length(item_text)), F.lit(0)).alias("n")).first()["n"]
    parts = 1 + size // (part_words * 6)
    sc, found = docs.sparkSession.sparkContext, None
    for part in range(parts):  # a larger set is searched part by part, each in a pass of its own
        own = items.select(item_id, item_text).distinct().where(F.pmod(F.xxhash64(item_id), F.lit(parts)) == part)
        tables = sc.broadcast(WuManber([(r[0], r[1]) for r in own.toLocalIterator()], width))
        hits = _scanned(docs, items, tables, doc_id, item_id, text)
        found = hits if found is None else found.unionByName(hits)
    return found.distinct()


def _scanned(docs: DataFrame, items: DataFrame, tables, doc_id: str, item_id: str, text: str) -> DataFrame:
    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        search = tables.value.search
        for b in batches:
            rows = [(i, d) for d, t in zip(b["d"], b["t"]) for i in search(t)]
            yield pd.DataFrame({item_id: [r[0] for r in rows], doc_id: [r[1] for r in rows]})

    kinds = f"{item_id} {items.schema[item_id].dataType.simpleString()}, {doc_id} {docs.schema[doc_id].dataType.simpleString()}"
    return docs.select(F.col(doc_id).alias("d"), F.col(text).alias("t")).where("t IS NOT NULL AND d IS NOT NULL").mapInPandas(scan, kinds)
