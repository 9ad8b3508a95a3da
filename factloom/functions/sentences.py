"""Procedural text steps inside Arrow batches: sentence spans and vocabulary-based repair."""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions import lexicons as L
from factloom.functions.text import classify_sentence
from factloom.session import small

LONGEST = 320
_SHORT = frozenset(L.ABBREVIATIONS)
_SPACE = re.compile(r"\s+")
_ITEM = re.compile(r"\s+(?=\d{1,2}[.)]\s+[A-Z])|\s+(?=[A-Z][A-Za-z ]{2,30}:\s)")
_BULLETS = "•·▪◦"


def _abbreviated(text: str, stop: int) -> bool:
    """Whether the point before position ``stop`` belongs to an abbreviation or an initial."""
    if text[stop - 1] != ".":
        return False
    start = stop - 1
    while start > 0 and (text[start - 1] == "." or (text[start - 1].isascii() and text[start - 1].isalpha())):
        start -= 1
    word = text[start: stop - 1]
    lone = bool(word) and word[-1].isupper() and (stop < 3 or not text[stop - 3].isalnum())
    return bool(word) and (lone or word.lower().rstrip(".") in _SHORT)


def sentence_spans(text: str) -> list[tuple[int, int]]:
    """(start, end) of each sentence in the text as it stands.

    One walk over the gaps of white space decides where a sentence ends: behind a terminator that closes no abbreviation.  A
    sentence with several bullets is cut at them; one that is over-long without a terminator is cut at its numbered or labelled
    items; whatever is still over-long ends at the first gap beyond the limit.
    """
    spans, start = [], 0
    for gap in _SPACE.finditer(text):
        if gap.start() > start and text[gap.start() - 1] in ".!?" and not _abbreviated(text, gap.start()):
            spans.append((start, gap.start()))
            start = gap.end()
    spans.append((start, len(text)))
    parts = []
    for a, z in spans:
        marks = [i for i in range(a, z) if text[i] in _BULLETS]
        if len(marks) > 1:
            parts += zip([a, *(i + 1 for i in marks)], [*marks, z])
        elif z - a > LONGEST and text[z - 1] not in ".!?":
            cuts = [m.start() for m in _ITEM.finditer(text, a, z)]
            parts += zip([a, *cuts], [*cuts, z])
        else:
            parts.append((a, z))
    out = []
    for a, z in parts:
        if z - a > LONGEST:
            for gap in _SPACE.finditer(text, a, z):
                if gap.start() - a >= LONGEST - 1:
                    out.append((a, gap.start()))
                    a = gap.end()
        out.append((a, z))
    trimmed = ((a + len(text[a:z]) - len(text[a:z].lstrip()), a + len(text[a:z].rstrip())) for a, z in out)
    return [(a, z) for a, z in trimmed if z > a]


def split_sentences(text: str | None) -> list[str]:
    """Sentences in order, line breaks read as blanks."""
    return [re.sub(r"\s*\n\s*", " ", text[a:z]) for a, z in sentence_spans(text)] if text else []


def sentences(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, pos, sentence, offset, length): sentences with their place in the text, in code points."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(k, i, re.sub(r"\s*\n\s*", " ", t[a:z]), a, z - a) for k, t in zip(b[key], b["t"]) for i, (a, z) in enumerate(sentence_spans(t))]
            yield pd.DataFrame(rows, columns=[key, "pos", "sentence", "offset", "length"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, F.col(text).alias("t")).where(f"{key} IS NOT NULL AND t IS NOT NULL").mapInPandas(run, f"{key} {kind}, pos int, sentence string, offset int, length int")


def classified(split: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Sentences with kind and quality; a last word that the vocabulary(word, n) hardly knows means a cut sentence."""
    last = F.lower(F.regexp_replace(F.regexp_extract("sentence", r"(\S+)\s*$", 1), "^[,;:]+|[,;:]+$", ""))
    known = split.withColumn("last_word", last).join(small(vocabulary.select(F.col("word").alias("last_word"), F.col("n").alias("last_n"))), "last_word", "left")
    graded = known.withColumn("graded", classify_sentence("sentence", F.coalesce("last_n", F.lit(0))))
    return graded.withColumns({"kind": F.col("graded.kind"), "quality": F.col("graded.quality")}).drop("last_word", "last_n", "graded")


def chunk_quality(graded: DataFrame, key: str) -> DataFrame:
    """Summed quality of a chunk's prose sentences over all its sentences, 3 dp half-even."""
    return graded.groupBy(key).agg(F.bround(F.sum(F.when(F.col("kind") == "prose", F.col("quality")).otherwise(0.0)) / F.count("*"), 3).alias("quality"), F.count("*").alias("sentences"))


# Signs that stand for others.
_REPLACE = str.maketrans({"­": "", "ﬁ": "fi", "ﬂ": "fl", "ﬀ": "ff", "ﬃ": "ffi", "ﬄ": "ffl", "‘": "'", "’": "'", "“": '"', "”": '"'})
_UNIT = re.compile(r"\w+|\W+")
_HEADER = re.compile(r"(?:\b[A-Z]\d{6}\s*[-–]?\s*)?\bpage\s+\d+\s+of\s+\d+\b[ \t]*", re.I)
_LEADING_NUMBER = re.compile(r"\s*\d{1,4}\s+(?=[A-Z][a-z])")


class Counts(Mapping):
    """Word counts as sorted 64-bit hashes with counts beside them: twelve bytes a word, so any vocabulary fits a task."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray):
        order = np.argsort(hashes)
        self.hashes, self.counts = hashes[order], counts[order].astype(np.int32)

    @staticmethod
    def of(vocabulary: DataFrame) -> Counts:
        rows = vocabulary.select(F.xxhash64("word").alias("h"), F.least("n", F.lit(2**31 - 1)).cast("int").alias("n")).toPandas()
        return Counts(rows["h"].to_numpy(dtype=np.int64), rows["n"].to_numpy())

    def __getitem__(self, word: str) -> int:
        h = np.uint64(xxhash.xxh64_intdigest(word.encode(), seed=42)).astype(np.int64)
        i = int(np.searchsorted(self.hashes, h))
        if i == len(self.hashes) or self.hashes[i] != h:
            raise KeyError(word)
        return int(self.counts[i])

    def __iter__(self):
        return iter(self.hashes.tolist())

    def __len__(self) -> int:
        return len(self.hashes)


class Repairer:
    """Walks over the words of a text and decides at each gap whether the layout put it there."""

    def __init__(self, vocab: Mapping[str, int], protected: frozenset[str] = frozenset()):
        self.count = lambda w: vocab.get(w.lower(), 0)
        self.protected = protected

    def halves(self, word: str) -> list[str]:
        """Two capitalised words written as one, apart; protected or well attested words stay whole."""
        inner = next((i for i in range(3, len(word) - 2) if word[i].isupper()), 0)
        fits = inner and word.isascii() and word.isalpha() and word[0].isupper() and word[1:inner].islower() and word[inner + 1:].islower()
        if not fits or word.lower() in self.protected or self.count(word) >= 5 or min(self.count(word[:inner]), self.count(word[inner:])) < 2:
            return [word]
        return [word[:inner], word[inner:]]

    def gap(self, left: str, gap: str, right: str, after: str) -> str:
        """What belongs between two words instead of ``gap``."""
        if not (left[-1].isalpha() and right[0].isalpha() and left.isascii() and right.isascii()):
            return gap
        whole = left.isalpha() and right.isalpha()
        if gap.strip() == "-" and len(gap) > 1:
            if gap[-1].isspace() and whole and min(len(left), len(right)) > 1 and right.islower():
                return "" if self.count(left + right) else "-"
            return "-"
        if gap != " " or not whole:
            return gap
        joined, single = self.count(left + right), max(self.count(left), self.count(right))
        split = min(len(left), len(right)) <= 3 and len(right) > 1 and joined > single
        orphan = len(right) == 1 and len(left) > 2 and right not in "aiAI" and after not in ("'", ".") and joined > 0
        return "" if split or orphan else gap

    def text(self, text: str) -> str:
        t = _HEADER.sub("", text.translate(_REPLACE)).lstrip()
        t = t[m.end():] if (m := _LEADING_NUMBER.match(t)) else t
        out: list[str] = []  # words and gaps by turns
        for m in _UNIT.finditer(t):
            unit = m.group(0)
            if not (unit[0].isalnum() or unit[0] == "_"):
                out.append(unit)
                continue
            for i, word in enumerate(self.halves(unit)):
                if i:
                    out.append(" ")
                elif len(out) > 1:
                    out[-1] = self.gap(out[-2], out[-1], word, t[m.end(): m.end() + 1])
                    if not out[-1]:
                        out.pop()
                        word = out.pop() + word
                out.append(word)
        flat = re.sub(r"[ \t]+", " ", "".join(out))
        return re.sub(r"\n{3,}", "\n\n", re.sub(r"\s+(?=[,.;:%])", "", flat)).strip()


def repair(text: str, vocab: Mapping[str, int], protected: frozenset[str] = frozenset()) -> str:
    """Text without layout damage, by what the vocabulary attests: ligatures, page headers wherever they stand, words
    fused, broken at hyphens or pulled apart by kerning, orphaned letters, spacing."""
    return Repairer(vocab, protected).text(text)


def repaired_text(df: DataFrame, key: str, vocabulary: DataFrame, text: str = "text", protected: frozenset[str] = frozenset()) -> DataFrame:
    """(key, text): repaired texts; the vocabulary travels as hashes.  Words of ``protected`` (lower case) are never taken apart."""
    shared = df.sparkSession.sparkContext.broadcast(Counts.of(vocabulary))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fix = Repairer(shared.value, protected).text
        for b in batches:
            yield pd.DataFrame({key: b[key], text: [fix(t) if t is not None else None for t in b["t"]]})

    return df.select(key, F.col(text).alias("t")).mapInPandas(run, f"{key} {df.schema[key].dataType.simpleString()}, {text} string")
