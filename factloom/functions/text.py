"""Scalar text functions as Column expressions (JVM-side, no Python per row)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from factloom.functions import lexicons as L

SLUG = "[^a-z0-9]+"


def tokens(c: Column | str) -> Column:
    """Lower-cased runs of ASCII letters and digits with more than one character; null stays null."""
    found = F.transform(F.regexp_extract_all(c, F.lit("[A-Za-z0-9]+"), 0), F.lower)
    return F.filter(found, lambda t: F.length(t) > 1)


def words(c: Column | str) -> Column:
    """Lower-cased runs of two letters or more."""
    return F.transform(F.regexp_extract_all(c, F.lit("[A-Za-z]{2,}"), 0), F.lower)


def content_tokens(c: Column | str, stop: list[str] = L.QUESTION_STOP) -> Column:
    return F.filter(tokens(c), lambda t: ~t.isin(*stop))


def sanitize(c: Column | str) -> Column:
    """Trimmed, white space collapsed; null words become the empty string."""
    t = F.trim(F.regexp_replace(c, r"\s+", " "))
    return F.coalesce(F.when(F.lower(t).isin("nan", "none", "null", "n/a"), "").otherwise(t), F.lit(""))


def or_default(c: Column | str, default: str) -> Column:
    s = sanitize(c)
    return F.when(s == "", F.lit(default)).otherwise(s)


def degenerate(c: Column | str) -> Column:
    """A query without any content: no token of two characters, or function words only."""
    t = tokens(c)
    return F.coalesce((F.size(t) == 0) | F.forall(t, lambda x: x.isin(*L.FUNCTION_WORDS)), F.lit(True))


def name_tokens(c: Column | str) -> Column:
    """Distinct tokens of a file name: no extension, no pure numbers."""
    t = F.split(F.regexp_replace(F.lower(c), r"\.[a-z]+$", ""), SLUG)
    return F.array_distinct(F.filter(t, lambda x: (F.length(x) > 1) & ~x.rlike("^[0-9]+$")))


def boilerplate_section(path: Column | str) -> Column:
    return F.coalesce(F.exists(path, lambda s: s.rlike(L.BOILERPLATE_SECTION)), F.lit(False))


def looks_like_heading(c: Column | str) -> Column:
    """A short line without sentence punctuation in capitals, or mostly of capitalised words."""
    t = F.trim(c)
    parts = F.filter(F.split(t, r"\s+"), lambda w: w != "")
    capital = F.size(F.filter(parts, lambda w: w.rlike("^[A-Z]")))
    shouted = (F.upper(t) == t) & t.rlike("[A-Z]") & (F.length(t) > 3)
    titled = t.rlike(r"^[A-Z][A-Za-z0-9 &/\-]{2,80}$") & (capital >= 0.6 * F.size(parts))
    return F.coalesce((F.length(t) > 0) & (F.length(t) <= 80) & ~t.rlike("[.,;:?!]$") & (shouted | titled), F.lit(False))


def stem_prefix(t: Column) -> Column:
    """The prefix that a term's variants share: common endings removed while four characters remain."""
    cut = F.lit(None).cast("string")
    for end in reversed(["ies", "ing", "ed", "er", "es", "s"]):
        stem = F.substring(t, F.lit(1), F.length(t) - len(end))
        ends = t.endswith(end) if end != "s" else t.endswith("s") & ~t.endswith("ss")
        cut = F.when(ends, F.when(F.length(stem) >= 4, stem).otherwise(t)).otherwise(cut)
    return F.coalesce(cut, t)


def jaccard(a: Column | str, b: Column | str) -> Column:
    """Overlap over union of two sets; 0 for two empty sets."""
    both = F.size(F.array_intersect(a, b))
    either = F.size(F.array_union(a, b))
    return F.when(either > 0, both / either).otherwise(0.0)


def containment(a: Column | str, b: Column | str) -> Column:
    """Overlap over the smaller set; 0 if one is empty."""
    least = F.least(F.size(F.array_distinct(a)), F.size(F.array_distinct(b)))
    return F.when(least > 0, F.size(F.array_intersect(a, b)) / least).otherwise(0.0)


def iso_date(y: Column, m: Column | None = None, d: Column | None = None, last_year: int = 2027) -> Column:
    """A date from parts, month kept in 1..12 and day in 1..28; null outside 2000 to ``last_year``."""
    part = lambda c, top: F.greatest(F.lit(1), F.least(F.lit(top), F.coalesce(F.expr("try_cast(null as int)") if c is None else c.try_cast("int"), F.lit(1))))
    year = y.try_cast("int")
    return F.when(year.between(2000, last_year), F.date_format(F.make_date(year, part(m, 12), part(d, 28)), "yyyy-MM-dd"))


def classify_sentence(s: Column | str, last_count: Column | int = 3) -> Column:
    """struct(kind, quality) of a sentence, so that each test runs once; last_count is how often its last word occurs in the corpus."""
    t = F.regexp_replace(s, r"^\s+|\s+\z", "")
    parts = F.filter(F.split(t, r"\s+"), lambda w: w != "")
    n, k = F.length(t), F.size(parts)
    alpha, digit = F.try_divide(F.regexp_count(t, F.lit(r"\p{L}")), n), F.try_divide(F.regexp_count(t, F.lit(r"\p{Nd}")), n)
    numeric = F.size(F.filter(parts, lambda w: w.rlike(r"^[0-9.,%()+\-]+$")))
    short = F.size(F.filter(parts, lambda w: F.length(w) <= 3))
    caps = F.size(F.filter(parts, lambda w: w.rlike(r"^\p{Lu}")))
    last = F.lower(F.regexp_replace(F.element_at(parts, -1), "^[,;:]+|[,;:]+$", ""))
    cut = ~t.rlike(r"[.!?:;)\]]$") & last.rlike(r"^\p{L}+$") & ~last.isin(*L.SHORT_ENDINGS) & (F.lit(last_count) if isinstance(last_count, int) else last_count) .__lt__(3)
    ended = t.rlike("[.!?]$")
    prose = (
        F.lit(0.55) + F.when(ended, 0.15).otherwise(0.0) + F.when(k.between(12, 45), 0.15).when(k > 70, -0.15).otherwise(0.0)
        + F.when(t.rlike(L.STATEMENT), 0.15).otherwise(0.0) + F.when(t.rlike(r"^\p{Lu}"), 0.05).otherwise(0.0) - F.when(digit > 0.10, 0.10).otherwise(0.0)
    )
    rules = [
        (n < 25, "fragment", F.lit(0.0)), (cut, "fragment", F.lit(0.0)), (t.rlike(L.CONTENTS), "header", F.lit(0.0)), (t.rlike(L.LEGAL), "legal", F.lit(0.05)),
        (t.rlike(L.EQUATION) | (alpha < 0.45), "equation", F.lit(0.05)),
        ((digit > 0.18) | ((k > 8) & (numeric > 0.30 * k)) | ((k > 10) & (short > 0.72 * k) & (numeric > 0)), "table", F.lit(0.1)),
        (~ended & (k <= 9) & (caps > 0.6 * k), "header", F.lit(0.15)),
    ]
    graded = F.struct(F.lit("prose").alias("kind"), F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), prose)), 3).alias("quality"))
    for test, name, q in reversed(rules):
        graded = F.when(test, F.struct(F.lit(name).alias("kind"), q.alias("quality"))).otherwise(graded)
    return graded
