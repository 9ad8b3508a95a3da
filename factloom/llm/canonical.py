"""Mapping free-entered values to a canonical list (problem 7).

A prefix-filter set-similarity join: tokens are ordered by global rarity, only the rare prefixes
are joined, length and positional filters prune the pairs, the Jaccard similarity of the rest is
verified exactly, and the best entry that agrees with everything the value states is kept.
Values are reduced to distinct signatures first, so copies cost nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.devices import completed, mentions, reference_parser
from factloom.session import small, stored

PARTS = ["brand", "qualifier", "analyte", "family"]


def prefix_join(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """Exact Jaccard join of left(l, tokens) and right(r, tokens): (l, r, similarity >= threshold).

    Token arrays are sets; an empty or null set joins nothing.  Exact for every pair at or above
    the threshold: two such sets share a token within both prefixes under any common order.
    """
    sets = left.select(F.lit("l").alias("side"), F.col("l").cast("string").alias("id"), "tokens").unionByName(
        right.select(F.lit("r").alias("side"), F.col("r").cast("string").alias("id"), "tokens"))
    each = sets.select("side", "id", F.explode(F.array_distinct("tokens")).alias("token"))
    rarity = each.groupBy("token").agg(F.count("*").alias("n"))
    ordered = (
        each.join(small(stored(rarity, "token-rarity")), "token").groupBy("side", "id")
        .agg(F.transform(F.sort_array(F.collect_list(F.struct("n", "token"))), lambda s: s["token"]).alias("tokens"))  # one set's tokens
    )
    size = F.size("tokens")
    prefixed = stored(ordered.select("side", "id", "tokens", size.alias("size"), (size - F.ceil(size * threshold - 1e-9) + 1).cast("int").alias("width")), "token-prefixes")
    heads = lambda side: prefixed.where(F.col("side") == side).select(
        F.col("id").alias(side), F.col("size").alias(f"{side}n"), F.posexplode(F.slice("tokens", 1, F.col("width"))).alias(f"{side}p", "token"))
    room = 1 + F.least(F.col("ln") - F.col("lp"), F.col("rn") - F.col("rp")) - 1
    need = threshold / (1 + threshold) * (F.col("ln") + F.col("rn")) - 1e-9
    pairs = (
        heads("l").join(small(heads("r")), "token")
        .where((F.col("ln") >= threshold * F.col("rn") - 1e-9) & (F.col("rn") >= threshold * F.col("ln") - 1e-9) & (room >= need))
        .select("l", "r").distinct()
    )
    whole = lambda side: prefixed.where(F.col("side") == side).select(F.col("id").alias(side), F.col("tokens").alias(f"{side}t"))
    shared = F.size(F.array_intersect("lt", "rt"))
    return (
        pairs.join(whole("l"), "l").join(small(whole("r")), "r")
        .select("l", "r", (shared / (F.size("lt") + F.size("rt") - shared)).alias("similarity")).where(F.col("similarity") >= threshold - 1e-9)
    )


def signature_tokens() -> Column:
    """Padded bigrams of the brand and the stated parts, as one token set."""
    padded = F.concat(F.lit("^"), F.col("brand"), F.lit("$"))
    grams = F.transform(F.sequence(F.lit(1), F.length(padded) - 1), lambda i: F.concat(F.lit("b:"), F.substring(padded, i, F.lit(2))))
    parts = F.array(F.concat(F.lit("q:"), F.col("qualifier")), *[F.when(F.col(c) != "", F.concat(F.lit(f"{c[0]}:"), F.col(c))) for c in ("analyte", "family")])
    return F.array_distinct(F.concat(grams, F.array_compact(parts)))


def typo_room(a: str, b: str) -> Column:
    """Whether two brands differ by no more edits than their length lets typing errors explain."""
    n = F.least(F.length(a), F.length(b))
    return F.levenshtein(a, b) <= F.when(n <= 4, 1).when(n <= 8, 2).otherwise(3)


def map_devices(texts: DataFrame, reference: DataFrame, ref_id: str = "ref_id", name: str = "canonical_name", company: str = "company", threshold: float = 0.3) -> DataFrame:
    """(key, ref_id, similarity): reference entries of the devices each text(key, field, text) is about.

    An entry fits a mention if brand (up to typing errors) and qualifier agree and neither a stated
    analyte nor a stated family differs; of those the most similar is kept, ties going to the mention's
    stated company, then to the smallest ref_id.  A key none of whose mentions fits gets one row with
    ref_id -1 and similarity null, so unmatched values are reported, not dropped.  Null or blank texts and
    null keys give no row; repeated rows count once; an empty reference maps everything to -1.
    """
    parser = reference_parser(reference, name, company)
    found = stored(completed(mentions(texts, parser)), "device-mentions")
    entries = mentions(reference.select(F.col(ref_id).cast("string").alias("key"), F.lit("r").alias("field"), F.col(name).alias("text")), parser).where("no > 0")
    entries = stored(entries.select(F.col("key").alias("r"), *[F.col(c).alias(f"r_{c}") for c in [*PARTS, "company"]]), "device-reference")
    sign = F.concat_ws("\u0001", *PARTS)
    signs = stored(found.where("no > 0").select(*PARTS).distinct().withColumn("l", sign), "device-signatures")
    tokens = prefix_join(signs.select("l", signature_tokens().alias("tokens")), entries.select("r", *[F.col(f"r_{c}").alias(c) for c in PARTS]).select("r", signature_tokens().alias("tokens")), threshold)
    fits = (
        tokens.join(small(entries), "r").join(signs, "l")
        .where((F.col("qualifier") == F.col("r_qualifier")) & (F.col("analyte").isin("") | (F.col("analyte") == F.col("r_analyte"))) & (F.col("family").isin("") | (F.col("family") == F.col("r_family"))))
        .where(typo_room("brand", "r_brand"))
        .groupBy("l").agg(F.max_by(F.struct("r", "similarity", "r_company"), F.struct("similarity", -F.levenshtein("brand", "r_brand"), -F.col("r").cast("bigint"))).alias("best"),
                          F.collect_list(F.struct("similarity", "r", "r_company")).alias("all"))  # at most the reference's sibling entries
    )
    tied = F.filter("all", lambda x: (x["similarity"] == F.col("best.similarity")) & (x["r_company"] == F.col("company")))
    chosen = F.when(F.size(tied) == 1, tied[0]["r"]).otherwise(F.col("best.r"))
    hits = found.where("no > 0").withColumn("l", sign).join(fits, "l", "left").select("key", "field", chosen.cast("bigint").alias("ref_id"), F.col("best.similarity").alias("similarity"))
    every = hits.unionByName(found.where("no = 0").select("key", "field", F.lit(None).cast("bigint").alias("ref_id"), F.lit(None).cast("double").alias("similarity")))
    per_key = every.groupBy("key", "field", "ref_id").agg(F.max("similarity").alias("similarity"))
    some = per_key.groupBy("key", "field").agg(F.collect_list(F.when(F.col("ref_id").isNotNull(), F.struct("ref_id", "similarity"))).alias("m"))  # one record's devices
    none = F.array(F.struct(F.lit(-1).cast("bigint").alias("ref_id"), F.lit(None).cast("double").alias("similarity")))
    return some.select("key", "field", F.inline(F.when(F.size("m") > 0, F.col("m")).otherwise(none)))
