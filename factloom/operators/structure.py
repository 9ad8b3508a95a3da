"""Document structure: headings, sections, chunk packing, identities and document metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factloom.functions.text import iso_date, looks_like_heading

TARGET, HEAD_CHARS = 700, 4000


def document_lines(docs: DataFrame, doc: str, text: str = "text") -> DataFrame:
    """(doc, line_no, line, heading): non-blank trimmed lines; null texts have none."""
    lines = docs.select(F.col(doc).alias("doc"), F.posexplode(F.split(text, "\n")).alias("p", "raw"))
    return lines.select("doc", (F.col("p") + 1).alias("line_no"), F.regexp_replace("raw", r"^\s+|\s+\z", "").alias("line")).where("line <> ''").withColumn("heading", looks_like_heading("line"))


def sections(lines: DataFrame) -> DataFrame:
    """Body lines with their breadcrumb: the last line in capitals and the last titled heading since it."""
    shouted = F.col("heading") & (F.upper("line") == F.col("line"))
    order = W.partitionBy("doc").orderBy("line_no")
    outer = F.last(F.when(shouted, F.struct("line_no", "line")), ignorenulls=True).over(order)
    inner = F.last(F.when(F.col("heading") & ~shouted, F.struct("line_no", "line")), ignorenulls=True).over(order)
    placed = lines.withColumns({"o": outer, "i": inner}).where("NOT heading")
    current = F.when(F.col("o").isNull() | (F.col("i.line_no") > F.col("o.line_no")), F.col("i.line"))
    return placed.select("doc", "line_no", "line", F.array_compact(F.array(F.col("o.line"), current)).alias("section_path"))


def _fold(items: Column, target: int, overlap: bool) -> Column:
    """Greedy packing of an ordered array of (ord, size): close a chunk when its size reaches the target."""
    chunk = "struct<first:int,last:int,n:int,chars:bigint>"
    empty = F.struct(F.lit(None).cast("int").alias("first"), F.lit(None).cast("int").alias("last"), F.lit(0).alias("n"), F.lit(0).cast("bigint").alias("chars"))
    start = F.struct(empty.cast(chunk).alias("open"), F.array().cast(f"array<{chunk}>").alias("done"))

    def step(s: Column, x: Column) -> Column:
        grown = F.struct(F.coalesce(s["open"]["first"], x["ord"]).alias("first"), x["ord"].alias("last"), (s["open"]["n"] + 1).alias("n"), (s["open"]["chars"] + x["size"]).alias("chars")).cast(chunk)
        carried = F.struct(x["ord"].alias("first"), x["ord"].alias("last"), F.lit(1).alias("n"), x["size"].alias("chars")).cast(chunk)
        after = F.when(grown["n"] > 1, carried).otherwise(empty.cast(chunk)) if overlap else empty.cast(chunk)
        full = grown["chars"] >= target
        return F.struct(F.when(full, after).otherwise(grown).alias("open"), F.when(full, F.concat(s["done"], F.array(grown))).otherwise(s["done"]).alias("done"))

    return F.aggregate(items, start, step, lambda s: F.when(s["open"]["n"] > 0, F.concat(s["done"], F.array(s["open"]))).otherwise(s["done"]))


def pack_paragraphs(paragraphs: DataFrame, doc: str, order: str, keys: list[str], text: str = "text", target: int = TARGET, overlap: bool = False) -> DataFrame:
    """Chunks of consecutive paragraphs of one document whose ``keys`` stay the same.

    A chunk closes once its texts reach ``target`` characters, or when a key changes; with ``overlap`` a full chunk
    of several paragraphs hands its last one to the next.  Returns doc, island, first, last, n, chars.  An
    island (one section on one page) is folded in one array, so its length should be bounded; repeated
    rows must have been dropped; null texts count as empty.
    """
    marked = _key_changes(paragraphs, doc, order, keys, text)
    islands = marked.withColumn("island", F.sum("new").over(W.partitionBy(doc).orderBy("ord").rowsBetween(W.unboundedPreceding, W.currentRow)))
    packed = islands.groupBy(doc, "island").agg(F.sort_array(F.collect_list(F.struct("ord", "size"))).alias("items"))
    return packed.select(doc, "island", F.inline(_fold(F.col("items"), target, overlap)))


def _key_changes(paragraphs: DataFrame, doc: str, order: str, keys: list[str], text: str) -> DataFrame:
    seq = W.partitionBy(doc).orderBy(order)
    key = F.to_json(F.struct(*keys), {"ignoreNullFields": "false"})
    base = paragraphs.select(F.col(doc), F.col(order).alias("ord"), F.coalesce(F.length(text), F.lit(0)).cast("bigint").alias("size"), key.alias("key"), F.lag(key).over(seq).alias("before"))
    return base.select(doc, "ord", "size", F.when(F.col("before").isNull() | (F.col("before") != F.col("key")), 1).otherwise(0).alias("new"))


def first_seen_ids(df: DataFrame, name: str, order: str) -> DataFrame:
    """(name, id): dense ids from 0 in order of first appearance; names are few next to rows."""
    firsts = df.where(F.col(name).isNotNull()).groupBy(name).agg(F.min(order).alias("first"))
    return firsts.select(name, (F.row_number().over(W.orderBy("first", name)) - 1).alias("id"))


def document_meta(chunks: DataFrame, doc: str, order: str, attributes: list[str]) -> DataFrame:
    """Per document the attributes of its first chunk and the number of chunks."""
    first = F.min_by(F.struct(*attributes), order)
    return chunks.groupBy(doc).agg(first.alias("a"), F.countDistinct(order).alias("chunk_count")).select(doc, "a.*", "chunk_count")


def head_text(chunks: DataFrame, doc: str, order: str, text: str = "text", limit: int = HEAD_CHARS) -> DataFrame:
    """Per document its leading chunks' texts, until ``limit`` characters are reached."""
    seq = W.partitionBy(doc).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    kept = chunks.select(doc, order, text, F.coalesce(F.sum(F.length(text)).over(seq), F.lit(0)).alias("before")).where(F.col("before") < limit)
    return kept.groupBy(doc).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, text))), lambda s: s[text]), "\n").alias("head"))  # bounded by limit


# Date patterns and the confidence of each way to date a document.
REVISED = r"(?i)\b(?:rev(?:ision)?|revised|effective|issued)\b[^.\n]{0,24}?(20[0-2][0-9])[-/]([0-9]{1,2})(?:[-/]([0-9]{1,2}))?"
ISO = r"\b(20[0-2][0-9])-([0-9]{2})-([0-9]{2})\b"
MONTH = r"(?i)\b(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.?\s+(20[0-2][0-9])\b"
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
CONFIDENCE = {"regulatory": 1.0, "document_control": 0.85, "text_date": 0.35, "unknown": 0.0}


def dated(regulatory: Column, text: Column, last_year: int = 2027) -> Column:
    """struct(date, method, confidence): a regulatory date, else a revision stamp, else a date in the first 4000 characters."""
    part = lambda c, p, i: F.nullif(F.regexp_extract(c, p, i), F.lit(""))
    head = F.substring(text, 1, HEAD_CHARS)
    pieces = F.split(regulatory, "-")
    official = F.when(regulatory.rlike(r"^20[0-2][0-9]-[0-9]{2}-[0-9]{2}$"), regulatory).when(
        regulatory.contains("-"), iso_date(F.get(pieces, 0), F.get(pieces, 1), F.get(pieces, 2), last_year))
    stamp = iso_date(part(head, REVISED, 1), part(head, REVISED, 2), part(head, REVISED, 3), last_year)
    plain = iso_date(part(head, ISO, 1), part(head, ISO, 2), part(head, ISO, 3), last_year)
    month = iso_date(part(head, MONTH, 2), F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(part(head, MONTH, 1))).cast("string"), F.lit("1"), last_year)
    in_text = F.coalesce(plain, month)
    date = F.coalesce(official, stamp, in_text)
    method = F.when(official.isNotNull(), "regulatory").when(stamp.isNotNull(), "document_control").when(in_text.isNotNull(), "text_date").otherwise("unknown")
    confidence = F.element_at(F.create_map(*[F.lit(x) for kv in CONFIDENCE.items() for x in kv]), method)
    return F.struct(date.alias("date"), method.alias("method"), confidence.alias("confidence"))
