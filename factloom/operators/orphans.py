"""References to records that do not exist (problem 2).

References and parent rows are hashed onto the same key, sorted by time and merged in one
linear pass: a running maximum of the parents' validity ends, read at each reference, tells
whether any parent that had been loaded by then was still alive.  No reference is ever joined
to a parent row, so repeated parents and repeated references cannot multiply.

A key may hold any share of the rows.  The merge therefore works on (key, month) slices; what
earlier months contribute to a slice is one pre-aggregated row, carried in as the first event.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Folded spellings that stand for "no reference".
PLACEHOLDERS = ("", "n/a", "none", "-", "unassigned")

_FOREVER = "TIMESTAMP '9999-12-31 00:00:00'"
_NEVER = "TIMESTAMP '0001-01-01 00:00:00'"


def fold_key(c: Column | str) -> Column:
    """Trimmed, lower-cased key; placeholders and blanks become null."""
    c = F.col(c) if isinstance(c, str) else c
    k = F.lower(F.regexp_replace(c, r"^\s+|\s+\z", ""))
    return F.when(~k.isin(*PLACEHOLDERS), k)


def orphan_references(refs: DataFrame, parents: DataFrame, payload: list[str]) -> DataFrame:
    """Orphans among refs(target, key, at, *payload) given parents(target, key, valid_from, valid_to).

    Keys arrive folded; rows with a null key are no references and no parents.  valid_to null
    means never deleted; a parent with null valid_from was never loaded.  Returns distinct
    (payload, target, key, at, status), status one of missing (no parent at any time), late
    (every parent is loaded after ``at``) and deleted (each parent loaded by ``at`` had ended).
    A reference with null ``at`` can see no parent: it is missing or late.  Empty inputs give an
    empty result; an empty parent table makes every reference missing.  Further columns are ignored.
    """
    bucket = lambda c: F.date_trunc("month", c)
    r = refs.where("key IS NOT NULL").select("target", "key", "at", F.struct(*payload).alias("p")).distinct()
    p = (
        parents.where("key IS NOT NULL AND valid_from IS NOT NULL")
        .groupBy("target", "key", F.col("valid_from").alias("at"))
        .agg(F.max(F.coalesce("valid_to", F.expr(_FOREVER))).alias("until"))
    )
    slices = (
        p.groupBy("target", "key", bucket("at").alias("b"))
        .agg(F.max("until").alias("until"), F.min("at").alias("first"), F.lit(False).alias("asked"))
        .unionByName(
            r.select("target", "key", bucket("at").alias("b")).distinct()
            .select("*", F.lit(None).cast("timestamp").alias("until"), F.lit(None).cast("timestamp").alias("first"),
                    F.lit(True).alias("asked"))
        )
        .groupBy("target", "key", "b")
        .agg(F.max("until").alias("until"), F.min("first").alias("first"), F.max("asked").alias("asked"))
    )
    by_key = W.partitionBy("target", "key")
    carry = slices.select(
        "target", "key", "b", "asked",
        F.max("until").over(by_key.orderBy(F.col("b").asc_nulls_first()).rowsBetween(W.unboundedPreceding, -1)).alias("until"),
        F.min("first").over(by_key).alias("first"),
    ).where("asked")
    none_p = F.lit(None).cast(r.schema["p"].dataType)
    none_t = F.lit(None).cast("timestamp")
    events = (
        carry.select("target", "key", "b", F.expr(_NEVER).alias("at"), F.lit(0).alias("kind"), "until", "first", none_p.alias("p"))
        .unionByName(p.select("target", "key", bucket("at").alias("b"), "at", F.lit(1).alias("kind"), "until", none_t.alias("first"), none_p.alias("p")))
        .unionByName(r.select("target", "key", bucket("at").alias("b"), "at", F.lit(2).alias("kind"), none_t.alias("until"), none_t.alias("first"), "p"))
    )
    merged = W.partitionBy("target", "key", "b").orderBy(F.coalesce("at", F.expr(_NEVER)), "kind").rowsBetween(W.unboundedPreceding, W.currentRow)
    seen = events.select(
        "target", "key", "at", "kind", "p",
        F.max("until").over(merged).alias("until"), F.min("first").over(merged).alias("first"),
    )
    return seen.where("kind = 2 AND (until IS NULL OR at IS NULL OR until <= at)").select(
        *[F.col(f"p.{c}").alias(c) for c in payload], "target", "key", "at",
        F.when(F.col("first").isNull(), "missing").when(F.col("until").isNull() | F.col("at").isNull(), "late").otherwise("deleted").alias("status"),
    )


def orphans_by_month(orphans: DataFrame) -> DataFrame:
    """Orphan records counted per source table, reference field, month and status."""
    return orphans.groupBy("source_table", "ref_field", F.date_format("at", "yyyy-MM").alias("period"), "status").agg(
        F.countDistinct("record_key").alias("records")
    )
