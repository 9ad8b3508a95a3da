"""Lines repeated across one source's documents (problem 6).

Lines are normalised (case, white space, digit runs) and parsed into templates by fixed-depth token
trees: below a source come the token count and then one level per token.  A branch that covers too
few documents to belong to a repeated line becomes the wildcard slot of its level, so slots are
learned, not listed.  Every task grows the branch counts of its own lines and the trees are merged by a
shuffle of those counts.  A template that covers many documents of its source is removed.  The merge
is exact: all branches of a line cover at least the line's own documents, so a line repeated often enough
is its own template without a slot, and its template's cover is its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.session import small, stored

SLOT = "<*>"


def normal_line(c: Column) -> Column:
    """Lower case, white space (space, tab, carriage return) collapsed and trimmed, digit runs to one 0."""
    squeezed = F.regexp_replace(F.regexp_replace(F.lower(c), "[ \t\r]+", " "), r"^ | \z", "")
    return F.regexp_replace(squeezed, "[0-9]+", "0")


def repeated_lines(df: DataFrame, item: str, document: str, source: str, text: str = "text", section: str = "section_path",
                   min_documents: int = 5, min_share: float = 0.04, literal_share: float = 0.7, depth: int = 24) -> tuple[DataFrame, DataFrame]:
    """(occurrences, templates) of lines that repeat excessively within a source.

    occurrences: item, line_no (from 1, blank lines counted), source, template, documents and literal, for every line whose
    template covers at least ``min_documents`` documents and ``min_share`` of the source's documents; literal marks
    templates without a slot, that is lines that themselves repeat so often.  A template with slots counts if ``literal_share`` of its
    tokens are literal and none but the first ``depth`` levels hold slots (tokens beyond stay literal).
    templates: source, template, documents, literal.  Blank lines and lines equal to an element of the item's own
    section path are neither considered nor counted.  Null texts have no lines; null sources form a
    source of their own; repeated rows give one occurrence; empty input gives empty results.
    """
    lines = (
        df.select(F.col(item).alias("item"), F.col(document).alias("doc"), F.col(source).alias("source"), F.col(section).alias("path"), F.posexplode(F.split(F.col(text), "\n", -1)).alias("p", "raw"))
        .select("item", "doc", "source", (F.col("p") + 1).cast("bigint").alias("line_no"), normal_line(F.col("raw")).alias("line"), F.transform("path", normal_line).alias("path"))
        .where((F.col("line") != "") & ~F.coalesce(F.array_contains("path", F.col("line")), F.lit(False)))
    )
    own = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("null"))  # a null source is a source
    lines = stored(lines.select("item", "doc", own.alias("s"), "line_no", "line"), "lines")
    needed = F.greatest(F.lit(float(min_documents)), F.lit(min_share) * F.count_distinct(document))
    sizes = stored(df.select(document, F.col(source).alias("source")).groupBy(own.alias("s")).agg(needed.alias("needed")), "line-sources")
    cover = stored(lines.select("s", "line", "doc").distinct(), "line-cover")  # hot sources spread over their lines
    kinds = stored(cover.groupBy("s", "line").agg(F.count("*").alias("k")), "line-kinds")
    # --- trees: branch counts are combined in each task before they are merged, sparse branches become slots
    tokens = F.split("line", " ")
    branches = kinds.select("s", "k", F.size(tokens).alias("n"), F.posexplode(F.slice(tokens, 1, depth)).alias("level", "token")).groupBy("s", "n", "level", "token").agg(F.sum("k").alias("k"))
    dense = branches.join(small(sizes), "s").where(F.col("k") >= F.col("needed"))
    levels = dense.groupBy("s", "n", "level").agg(F.collect_list("token").alias("kept"))  # at most 1 / min_share tokens for each line of a document
    by_level = levels.groupBy("s", "n").agg(F.map_from_entries(F.collect_list(F.struct("level", "kept"))).alias("m"))  # at most ``depth`` levels
    none = F.array().cast("array<string>")
    trees = stored(by_level.select("s", "n", F.transform(F.sequence(F.lit(0), F.lit(depth - 1)), lambda i: F.coalesce(F.col("m")[i], none)).alias("tree")), "line-trees")
    slotted = F.transform(tokens, lambda t, i: F.when((i >= depth) | F.array_contains(F.get("tree", i), t), t).otherwise(F.lit(SLOT)))
    parsed = kinds.withColumn("n", F.size(tokens)).join(small(trees), ["s", "n"]).select("s", "line", "k", slotted.alias("t")).withColumn("held", F.size(F.filter("t", lambda x: x != SLOT)))
    parsed = parsed.where(F.col("held") >= F.ceil(literal_share * F.size("t"))).select("s", "line", "k", F.array_join("t", " ").alias("template"), (F.col("held") == F.size("t")).alias("literal"))
    parsed = stored(parsed, "line-parsed")
    # a template without slots is one line, whose documents are counted already; the others gather those of their lines
    gathered = cover.join(small(parsed.where("NOT literal").select("s", "line", "template")), ["s", "line"]).select("s", "template", "doc").distinct().groupBy("s", "template").agg(F.count("*").alias("documents"))
    counts = parsed.where("literal").select("s", "template", "literal", F.col("k").alias("documents")).unionByName(gathered.withColumn("literal", F.lit(False)))
    found = stored(counts.join(small(sizes), "s").where(F.col("documents") >= F.col("needed")).drop("needed"), "line-templates")
    of_lines = stored(parsed.drop("k").join(small(found), ["s", "template", "literal"]), "line-found")
    hits = lines.join(small(of_lines), ["s", "line"]).select("s", "item", "line_no", "template", "documents", "literal").distinct()
    named = F.when(F.col("s") != "null", F.substring("s", 2, 1 << 30)).cast(df.schema[source].dataType).alias("source")
    return hits.select("item", "line_no", named, "template", "documents", "literal"), found.select(named, "template", "documents", "literal")


def without_repeated_lines(df: DataFrame, occurrences: DataFrame, item: str, text: str = "text") -> DataFrame:
    """item and cleaned text: each text without its repeated lines, other lines as stored.

    Items without such a line keep their text; null texts stay null; repeated rows collapse.
    """
    drop = occurrences.groupBy(F.col("item").alias("i")).agg(F.collect_set("line_no").alias("gone"))  # bounded by one text's lines
    kept = F.filter(F.split(F.col("t"), "\n", -1), lambda x, i: ~F.array_contains(F.col("gone"), (i + 1).cast("bigint")))
    return (
        df.select(F.col(item).alias("item"), F.col(text).alias("t")).distinct().join(drop, F.col("item") == F.col("i"), "left")
        .select(F.col("item").alias(item), F.when(F.col("gone").isNull(), F.col("t")).otherwise(F.array_join(kept, "\n")).alias(text))
    )
