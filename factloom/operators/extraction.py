"""Entities written in plain text: runs of capitalised words and acronyms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import lexicons as L

# A run of up to five capitalised words, and an acronym.
CAPITALISED = r"[A-Z][a-zA-Z0-9]+(?:[\s-][A-Z][a-zA-Z0-9]+){0,4}"
CAPITALS = r"[A-Z]{2,6}"
# word ends are spelled out, as what \b takes for a letter differs between engines
PROPER, ACRONYM = (rf"(?<![\p{{L}}\p{{N}}_])({p})(?![\p{{L}}\p{{N}}_])" for p in (CAPITALISED, CAPITALS))
# Words that open a name without belonging to it.
LEADING = "the a an for every each some most any all this that these those when if since while although however therefore thus".split()


def canonical_name(name: Column | str) -> Column:
    """Lower case, white space squeezed, one leading article-like word removed where more follows."""
    flat = F.lower(F.trim(F.regexp_replace(name, r"\s+", " ")))
    return F.regexp_replace(flat, rf"^(?:{'|'.join(LEADING)}) ", "")


def display_name(name: Column | str) -> Column:
    """The name as written without one leading article-like word."""
    return F.regexp_replace(F.trim(name), rf"(?i)^(?:{'|'.join(LEADING)}) ", "")


def extracted_entities(df: DataFrame, key: str, text: str = "text", stop: list[str] = L.FUNCTION_WORDS) -> DataFrame:
    """(key, pos, name, canonical, kind): mentions in order, proper nouns before acronyms.

    Names of stop words only and names under three characters that stand alone are left out; an acronym also counts where
    it is part of a proper noun.  Null texts give no row; repeated rows give their mentions again.
    """
    found = lambda pattern, kind: F.transform(F.regexp_extract_all(text, F.lit(pattern), 1), lambda n: F.struct(n.alias("name"), F.lit(kind).alias("kind")))
    words = F.split(F.lower(F.col("m.name")), r"\s+")
    every = df.select(F.col(key), F.posexplode(F.concat(found(PROPER, "proper_noun"), found(ACRONYM, "acronym"))).alias("pos", "m"))
    kept = every.where(~F.forall(words, lambda w: w.isin(*stop)) & ((F.col("m.kind") == "acronym") | (F.size(words) > 1) | (F.length("m.name") >= 3)))
    return kept.select(key, "pos", display_name(F.col("m.name")).alias("name"), canonical_name(F.col("m.name")).alias("canonical"), F.col("m.kind").alias("kind"))
