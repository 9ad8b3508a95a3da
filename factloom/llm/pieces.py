"""Splitting oversized texts at natural boundaries (problem 3).

One bounded-quantifier pattern consumes a text from left to right.  Its alternatives are
ordered by boundary strength; each takes as much as fits under the limit, and the last takes
characters.  Everything is Spark SQL: regexp_extract_all yields the cores, sums by block
yield their offsets, and each piece starts up to ``overlap`` characters before its core, at a
word start where the lookback window holds one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Pieces whose lengths are added up together.
BLOCK = 256


def core_pattern(room: int) -> str:
    """The ordered alternatives for cores of at most ``room`` characters.

    A boundary counts only in the last half of the room, so that pieces stay large; a strong
    boundary there wins over a weaker one further on.
    """
    low = room // 2
    upto = lambda tail, n: rf"[\s\S]{{{low},{room - n}}}{tail}"
    return "|".join([
        rf"[\s\S]{{1,{room}}}\z",             # the rest fits
        upto(r"\n[ \t\r]*\n", 8),             # paragraph; the slack bounds the blank run
        upto(r"\n", 1),                       # line
        upto(r"[.!?…][\"'”»)\]]?\s", 3),      # sentence
        upto(r"[;:,–—]\s", 2),                # clause
        upto(r"\s", 1),                       # word
        rf"[\s\S]{{1,{room}}}",               # characters
    ])


def split_oversized(df: DataFrame, keys: list[str], text: str = "text", limit: int = 1000, overlap: int = 100) -> DataFrame:
    """Ordered pieces of every text longer than ``limit`` code points.

    Returns keys, piece_no (from 1), n_pieces, start (0-based offset of the core), lead
    (characters repeated from the piece before) and piece.  Every piece has at most ``limit``
    code points; dropping each piece's first ``lead`` characters and concatenating gives back the
    text exactly.  Texts that are null, empty or not longer than the limit give no rows; repeated
    rows are collapsed; further columns, whatever their names, are not carried.
    """
    if not 0 <= overlap < limit - 16:
        raise ValueError("overlap must leave room for a core")
    room = limit - overlap
    big = df.select(*keys, F.col(text).alias("__t")).where(F.length("__t") > limit).distinct()
    # an exploded row carries one core and the few characters before it, so a text is read a fixed number of times whatever its length
    cores = big.select(*keys, F.regexp_extract_all("__t", F.lit(core_pattern(room)), 0).alias("__c"))
    back = -(-overlap // (room // 2))  # cores that a lookback window may reach over
    c = F.col("__c")
    window = lambda i: F.right(F.array_join(F.slice(c, F.greatest(i - back, F.lit(0)) + 1, F.least(i, F.lit(back))), ""), F.lit(overlap)) if overlap else F.lit("")
    sized = cores.select(*keys, "__c", F.transform(c, F.length).alias("__n"))
    sums = sized.select(*keys, "__c", "__n", _block_starts(F.col("__n")).alias("__b"))
    first = lambda i: F.get(F.col("__b"), (i / BLOCK).cast("int")) + _total(F.slice(F.col("__n"), (i / BLOCK).cast("int") * BLOCK + 1, i % BLOCK))
    parts = sums.select(*keys, F.size("__n").alias("n_pieces"), F.posexplode(F.transform(c, lambda core, i: F.struct(core.alias("core"), window(i).alias("before"), first(i).alias("start")))).alias("__i", "__p"))
    # the longest suffix of the window that begins at a word; the whole window where it has no gap
    tail = F.regexp_extract("__p.before", r"^\S*\s([\s\S]*)$", 1)
    lead = F.when(F.length(tail) > 0, tail).otherwise(F.col("__p.before"))
    return parts.select(*keys, (F.col("__i") + 1).alias("piece_no"), "n_pieces", F.col("__p.start").alias("start"), F.length(lead).alias("lead"), F.concat(lead, "__p.core").alias("piece"))


def _total(lengths: Column) -> Column:
    return F.aggregate(lengths, F.lit(0), lambda a, n: a + n)


def _block_starts(lengths: Column) -> Column:
    """Where each block of lengths starts: sums of the blocks before it, so that no offset adds up a whole text."""
    blocks = F.sequence(F.lit(0), ((F.size(lengths) - 1) / BLOCK).cast("int"))
    sums = F.transform(blocks, lambda b: _total(F.slice(lengths, b * BLOCK + 1, F.lit(BLOCK))))
    return F.transform(blocks, lambda b: _total(F.slice(sums, F.lit(1), b)))
