"""Reading free-typed device descriptions into structured mentions.

Shared by the record-matching (problem 1) and the reference-mapping operator
(problem 7).  A description names zero, one or two devices; a device has a brand,
an optional line qualifier, an analyte, a product family and a model designation,
in any order, case, language and abbreviation.  Parsing is plain per-row text work,
so it runs inside Arrow batches next to the scan; nothing here needs a shuffle.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The ways an analyte is written.
ANALYTES = {
    "glucose": ["glucose", "gluc", "glu", "blood sugar", "blood glucose", "glukose", "glucosa"],
    "creatinine": ["creatinine", "creatinin", "creat", "crea", "kreatinin", "creatinina"],
    "lactate": ["lactate", "lactic acid", "lact", "lac", "laktat", "lactato"],
    "urea": ["urea nitrogen", "urea", "bun", "harnstoff", "uree"],
    "uric acid": ["uric acid", "urate", "ua"],
    "ketone": ["b-ketone", "beta-ketone", "ketone", "ketones", "ket", "bhb"],
    "hemoglobin": ["hemoglobin", "haemoglobin", "hgb", "hb"],
    "hematocrit": ["hematocrit", "haematocrit", "hct"],
    "bilirubin": ["total bilirubin", "bilirubin", "tbil", "bili"],
    "sodium": ["sodium", "na+", "na"],
    "potassium": ["potassium", "potass", "k+"],
    "ionized calcium": ["ionized calcium", "ionised calcium", "ica", "ca++"],
    "magnesium": ["magnesium", "magn", "mg++"],
    "ammonia": ["ammonia", "ammon", "nh3"],
    "blood gas": ["blood-gas", "blood gas", "ph/gas", "bg"],
    "chloride": ["chloride", "cl-"],
}
# The ways a product family is written.
FAMILIES = {
    "analyzer": ["analyzer system", "analyzer sys", "analyzer", "analyser system", "analyser",
                 "analysator", "analyseur", "analizador"],
    "meter": ["hospital meter system", "monitoring system", "meter system", "meter",
              "messgerät", "messgeraet", "lecteur", "medidor"],
    "cartridge": ["sensor cartridge", "sensor cart", "cartridge", "sensorkassette", "cartucho", "cart"],
    "strip": ["test strips", "test strip", "strips", "strip", "bandelettes", "tiras reactivas",
              "teststreifen"],
    "control": ["control solution", "control sol", "qc solution", "controls", "control",
                "kontrolllösung", "kontrollloesung"],
}
# The ways a line qualifier is written.
QUALIFIERS = {
    "neonatal": ["neonatal", "neonat", "neo"],
    "mini": ["mini"],
    "plus": ["plus", "+"],
    "gen 2": ["generation 2", "gen 2", "gen2", "g2", "ii"],
    "duo": ["duo"],
    "pro": ["professional", "pro"],
    "xpress": ["xpress", "express", "xp"],
}
# Legal forms and trade words that follow a company's first name.
COMPANY_WORDS = {"corporation", "corp", "ltd", "gmbh", "inc", "llc", "instruments", "biosensing",
                 "medical", "diagnostics", "assay", "works", "co", "ag"}
# Words of forms and furniture that never belong to a brand.
FILLER = {"system", "sys", "sensor", "test", "solution", "sol", "hospital", "monitoring", "model", "mod",
          "catalog", "ref", "data", "manager", "accessories", "incl", "calibrators", "bundled"}
# Words of entries that name no device, when an entry holds nothing else.
NO_DEVICE = {"the", "and", "accessory", "kit", "kits", "product", "products", "device", "devices", "is", "various",
             "replacement", "parts", "part", "all", "lots", "remanufactured", "n/a", "na", "none", "unknown", "tbd",
             "see", "attached", "attachment", "name", "not", "stated", "provided", "specified", "available",
             "unspecified", "of", "for", "with", "notice", "multiple", "supplies", "spare", "same", "as",
             "above", "pending", "misc", "other", "assorted", "item", "items", "medical", "letter", "below"}

# Phrases that open the part of a recall text behind the device itself.
TAIL = re.compile(
    r"(?:^|[\s.,;\-(\[]+)(?:for use with|used with|use with|product usage|intended for|for near-patient"
    r"|cat\.? no\b|catalog number|p/n|lot numbers?\b|all lots|remanufactured|accessories\b"
    r"|incl\.? |including |bundled|and data manager|with data manager|compatible with|works with).*$",
    re.S,
)
HEAD = re.compile(r"^\s*(?:product\s*:|affected device is(?: the)?|device\s*:)\s*")
USED = re.compile(r"to monitor ([a-z ]+?)[.]|determination of ([a-z ]+?) in |measurement of ([a-z ]+?) (?:at|in|during) "
                  r"|testing of ([a-z ]+?) by ")
#: Letters, an optional gap and digits (with o, i, l for misread 0 and 1): whatever may be a model designation.
DESIGNATION = r"(?<![a-z0-9])([a-z]{1,4})[\s.\-]{0,2}([0-9oil]{2,6})(?![a-z0-9])"
# Words that a number follows without being a designation.
NUMBERED = {"no", "nos", "lot", "lots", "lpn", "ifu", "gen", "n", "p", "v", "ver", "rev", "vol", "page", "of", "for", "and", "to", "in", "with", "size", "qty"}
SHAPES = frozenset({(2, 4)})
STRONG_SPLIT = re.compile(r"\s*;\s*|\s*\(\d\)\s+")
SPLIT = re.compile(r"\s+and\s+(?=\S)")
DIGIT = str.maketrans("oil", "011")


def _spellings(table: dict[str, list[str]]) -> tuple[re.Pattern, dict[str, str]]:
    to = {s: k for k, v in table.items() for s in v}
    alt = "|".join(re.escape(s) for s in sorted(to, key=len, reverse=True))
    return re.compile(rf"(?<![\w+/])(?:{alt})(?:\.(?=\W|$))?(?![\w+])"), to


_ANALYTE, _FAMILY, _QUALIFIER = map(_spellings, (ANALYTES, FAMILIES, QUALIFIERS))


@dataclass
class Mention:
    """One device as named by a description; absent parts are empty strings."""

    brand: str = ""
    qualifier: str = ""
    analyte: str = ""
    family: str = ""
    code: str = ""
    company: str = ""
    words: list[str] = field(default_factory=list)


def fold(text: str) -> str:
    """Case, width and mark folding shared by all device text."""
    t = re.sub(r"[™®©]|\((?:r|tm|c)\)", " ", text, flags=re.I)
    t = unicodedata.normalize("NFKC", t).lower()
    t = re.sub(r"[‐-―−]", "-", t)
    return re.sub(r"\s+", " ", t).strip()


def _take(text: str, spec: tuple[re.Pattern, dict[str, str]]) -> tuple[str, str]:
    """The canonical form of the first spelling found, and the text without any."""
    pattern, to = spec
    found = [to[m.group(0).rstrip(".") if m.group(0) not in to else m.group(0)] for m in pattern.finditer(text)]
    return (found[0] if found else ""), (pattern.sub(" ", text) if found else text)


class DeviceParser:
    """Parser with the known company and brand names and the shapes of designations (letters, digits) in use."""

    def __init__(self, companies: set[str], brands: set[str] | KnownNames = frozenset(), shapes: frozenset[tuple[int, int]] = SHAPES):
        self.brands = brands
        forms = "|".join(rf"([a-z]{{{a}}})[\s.\-]{{0,2}}([0-9oil]{{{d}}})" for a, d in sorted(shapes))
        self.code = re.compile(rf"(?:\b(?:model/catalog|model|mod\.?|ref\.?)\s*)?(?<![a-z0-9])(?:{forms})(?![a-z0-9])")
        firsts = {c.split()[0].lower().strip(".,") for c in companies if c and c.split()}
        self.companies = firsts
        self.short = {c[:4]: c for c in sorted(firsts, reverse=True)}

    def device(self, text: str, hint: str = "") -> Mention | None:
        """One device from its own part of the description, or None without a brand."""
        m, code = self.code.search(text), ""
        while m and not code:
            letters, digits = (g for g in m.groups() if g)
            if letters not in NUMBERED and any(c.isdigit() for c in digits):
                code = (letters + digits.translate(DIGIT)).upper()
                text = text[: m.start()] + " " + text[m.end():]
            else:
                m = self.code.search(text, m.start() + 1)
        text = re.sub(r"\(?\bgen\.? ?2\)?|\(gen\. 2\)", " gen 2 ", text)
        text = re.sub(r"\b(?:model/catalog|model|mod\.|ref)(?=[\s),]|$)", " ", text)
        analyte, text = _take(text, _ANALYTE)
        family, text = _take(text, _FAMILY)
        qualifier, text = _take(text, _QUALIFIER)
        brand, company = {}, ""  # words in order, each once
        for raw in re.split(r"[\s,()\[\]/:|\"]+", text):
            w = raw.strip(".-'")
            if not w or w in FILLER or not any(c.isalpha() for c in w):
                continue
            if w in self.companies and not company:
                company = w
            elif raw.endswith(".") and len(w) == 4 and not company:
                company = self.short.get(w, w)
            elif w in COMPANY_WORDS:
                continue
            else:
                brand[w.replace("-", "")] = True
        words = list(brand)
        joined = "".join(words)
        if len(words) > 2 and joined not in self.brands:  # running text around the name: the known brand in it is meant
            joined = next((w for w in [*words, *map("".join, zip(words, words[1:]))] if w in self.brands), joined)
        if qualifier and joined not in self.brands:  # a brand typed in two words, one like a qualifier
            whole = next((w for q in QUALIFIERS[qualifier] for w in (joined + q, q + joined) if w in self.brands), "")
            joined, qualifier = (whole, "") if whole else (joined, qualifier)
        if len(joined) < 3 or all(w in NO_DEVICE for w in words):
            return None
        return Mention(joined, qualifier, analyte or hint, family, code, company, words)

    def listed(self, text: str) -> list[str]:
        """The parts joined by "and", apart; an "and" that is a piece of a known brand typed in words is joined to it."""
        parts = SPLIT.split(text)
        out = parts[:1]
        for part in parts[1:]:
            before, after = re.search(r"\w*$", out[-1]).group(0), re.match(r"\w*", part).group(0)
            if before and f"{before}and{after}" in self.brands:
                out[-1] += f"and{part}"
            elif before and f"{before}and" in self.brands:
                out[-1] += f"and {part}"
            elif f"and{after}" in self.brands:
                out[-1] += f" and{part}"
            else:
                out.append(part)
        return out

    def parse(self, text: str | None) -> list[Mention]:
        """Mentions in order; null, blank and device-free descriptions give none.

        What a device is used with, and its accessories, are cut off each listed device on its own, so
        that they hide no device listed behind them.
        """
        if not text or not text.strip():
            return []
        t = HEAD.sub("", fold(text))
        used = USED.search(t)
        parts = [q for p in STRONG_SPLIT.split(t) for q in self.listed(TAIL.sub("", p)) if q and q.strip()]
        hint = ""
        if used and len(parts) == 1:
            hint, _ = _take(next(g for g in used.groups() if g), _ANALYTE)
        return [d for p in parts if (d := self.device(p, hint))]


class KnownNames:
    """A set of names kept as sorted 64-bit hashes, eight bytes each, so that a list of any usual length fits every task."""

    def __init__(self, names: Iterable[str] = ()):
        self.hashes = np.unique(np.fromiter((xxhash.xxh3_64_intdigest(n) for n in names), dtype=np.uint64))

    def __contains__(self, name: str) -> bool:
        h = np.uint64(xxhash.xxh3_64_intdigest(name))
        i = int(np.searchsorted(self.hashes, h))
        return i < len(self.hashes) and self.hashes[i] == h


def designation_shapes(texts: DataFrame, share: float = 0.05) -> frozenset[tuple[int, int]]:
    """Shapes (letters, digits) of the designations in use: those that make up ``share`` of all candidates in text.

    Counted over all texts and combined map-side; at most 24 shapes exist.
    """
    plain = F.lower(F.regexp_replace("text", "[‐-―−]", "-"))
    each = texts.select(F.explode(F.regexp_extract_all(plain, F.lit(DESIGNATION), 0)).alias("m"))
    parts = each.select(F.regexp_extract("m", DESIGNATION, 1).alias("a"), F.regexp_extract("m", DESIGNATION, 2).alias("d")).where(F.col("d").rlike("[0-9]") & ~F.col("a").isin(*sorted(NUMBERED)))
    counts = parts.groupBy(F.length("a").alias("a"), F.length("d").alias("d")).agg(F.count("*").alias("n")).collect()
    whole = sum(r["n"] for r in counts)
    return frozenset((r["a"], r["d"]) for r in counts if r["n"] >= share * whole) or SHAPES


MENTION_SCHEMA = "key string, field string, no int, brand string, qualifier string, analyte string, family string, code string, company string"


def reference_parser(reference: DataFrame, name: str = "canonical_name", company: str = "company", texts: DataFrame | None = None) -> DeviceParser:
    """A parser that knows the companies and brands of a reference list, and the designation shapes of ``texts``."""
    rows = reference.select(name, company).distinct()
    companies = {r[0] for r in reference.select(company).distinct().toLocalIterator() if r[0]}
    plain = DeviceParser(companies)
    known = KnownNames(m.brand for r in rows.toLocalIterator() for m in plain.parse(r[0]))
    return DeviceParser(companies, known, SHAPES if texts is None else designation_shapes(texts))


def mentions(texts: DataFrame, parser: DeviceParser, carry: list[str] = []) -> DataFrame:  # noqa: B006
    """Device mentions of texts(key, field, text), numbered within a text; see MENTION_SCHEMA.

    A text without a device gives one row with no = 0 and empty parts; null and blank texts give none.  ``carry`` names
    further string columns to keep.
    """
    shared = texts.sparkSession.sparkContext.broadcast(parser)
    names = ["key", "field", *carry, "no", "brand", "qualifier", "analyte", "family", "code", "company"]

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        read = lru_cache(20_000)(lambda t: tuple(shared.value.parse(t)))
        for b in batches:
            rows = []
            for *own, text in zip(b["key"], b["field"], *[b[c] for c in carry], b["text"]):
                found = read(text)
                if not found:
                    rows.append((*own, 0, "", "", "", "", "", ""))
                for i, m in enumerate(found):
                    rows.append((*own, i + 1, m.brand, m.qualifier, m.analyte, m.family, m.code, m.company))
            yield pd.DataFrame(rows, columns=names)

    given = texts.select("key", "field", *carry, "text").where(F.col("key").isNotNull() & (F.length(F.regexp_replace("text", r"\s+", "")) > 0)).distinct()
    return given.mapInPandas(parse, MENTION_SCHEMA.replace("no int", "".join(f"{c} string, " for c in carry) + "no int"))


def completed(found: DataFrame, by: tuple[str, ...] = ("code", "qualifier", "initial")) -> DataFrame:
    """Mentions whose missing analyte or family is filled from mentions of the same designation.

    Mentions that agree on ``by`` (initial is the brand's first letter) and of which all that state an analyte (family) state
    the same one lend it to those without.  Hot designations are pre-aggregated before the join.
    """
    one = lambda c: F.when(F.min(F.nullif(c, F.lit(""))) == F.max(F.nullif(c, F.lit(""))), F.max(F.nullif(c, F.lit(""))))
    initial = F.substring("brand", 1, 1)
    known = found.where("code <> ''").withColumn("initial", initial).groupBy(*by).agg(one(F.col("analyte")).alias("ka"), one(F.col("family")).alias("kf"))
    full = lambda c, k: F.when(F.col(c) != "", F.col(c)).otherwise(F.coalesce(F.col(k), F.lit("")))
    lacking = (F.col("code") != "") & ((F.col("analyte") == "") | (F.col("family") == ""))
    filled = (
        found.where(lacking).withColumn("initial", initial).join(known, list(by), "left")
        .withColumns({"analyte": full("analyte", "ka"), "family": full("family", "kf")}).select(*found.columns)
    )
    return found.where(~lacking).unionByName(filled)
