"""What the graph adds to an answer: bridges between cited documents, weakly related pairs, citation lineage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factloom.functions.text import content_tokens
from factloom.session import small

#: Fixed value: vocabulary overlap below which two cited documents are joined by the graph only.
GRAPH_ONLY = 0.22


def entity_documents(mentions: DataFrame, entity: str = "canonical", document: str = "document_id", chunk: str = "chunk_id") -> DataFrame:
    """(entity, document, chunks): the documents of every entity, one row each, so a hot entity is no single list.

    Entities are folded; null or blank ones and null documents give no row.
    """
    base = mentions.select(F.lower(F.trim(F.col(entity))).alias("entity"), F.col(document).alias("document"), F.col(chunk).alias("c")).where("entity <> '' AND document IS NOT NULL")
    return base.groupBy("entity", "document").agg(F.countDistinct("c").alias("chunks"))


def chunk_entities(mentions: DataFrame, entity: str = "canonical", chunk: str = "chunk_id") -> DataFrame:
    """(chunk, entities): the folded entities of each chunk in order, one chunk's entities being few."""
    base = mentions.select(F.col(chunk).alias("chunk"), F.lower(F.trim(F.col(entity))).alias("e")).where("chunk IS NOT NULL AND e <> ''")
    return base.groupBy("chunk").agg(F.array_sort(F.collect_set("e")).alias("entities"))


def bridges(cited: DataFrame, linked: DataFrame, documents: int, focus: DataFrame, cross: DataFrame, most: int = 4) -> DataFrame:
    """(query, entity, shared, reach, on_topic, cross_source, weight, place): entities that join a query's cited documents.

    cited(query, document), linked(entity, document), focus(query, focus), cross(entity) with the entities of several sources.
    Entities of two cited documents or more are weighed by topic, source crossing, rarity and share of the citations; the
    ``most`` heaviest stay, ties go to the first by name.  A query with fewer than two cited documents has none.
    """
    asked = cited.select("query", "document").distinct()
    sizes = asked.groupBy("query").agg(F.count("*").alias("docs")).where("docs > 1")
    met = linked.join(small(asked), "document").groupBy("query", "entity").agg(F.count("*").alias("shared")).where("shared > 1")
    reach = linked.join(small(met.select("entity").distinct()), "entity", "left_semi").groupBy("entity").agg(F.count("*").alias("reach"))
    on_topic = F.exists(F.coalesce("focus", F.array().cast("array<string>")), lambda f: F.col("entity").contains(f) | f.contains(F.col("entity")))
    every = (
        met.join(sizes, "query").join(reach, "entity").join(focus, "query", "left").join(cross.select("entity", F.lit(True).alias("x")), "entity", "left")
        .withColumns({"on_topic": F.coalesce(on_topic, F.lit(False)), "cross_source": F.coalesce("x", F.lit(False))})
    )
    rare = 1 - F.least(F.lit(1.0), F.col("reach") / F.lit(max(documents, 1)))
    weight = 3 * F.col("on_topic").cast("int") + 1.2 * F.col("cross_source").cast("int") + 1.5 * rare + F.least(F.lit(1.0), F.col("shared") / F.col("docs"))
    ranked = every.select("query", "entity", "shared", "reach", "on_topic", "cross_source", F.round(weight, 6).alias("weight"))
    return ranked.withColumn("place", F.row_number().over(W.partitionBy("query").orderBy(F.desc("weight"), "entity"))).where(F.col("place") <= most)


def overlap_ratio(a: Column | str, b: Column | str) -> Column:
    """Shared share of the smaller set; 1 where either is empty, as nothing can then be said against it."""
    least = F.least(F.size(F.array_distinct(a)), F.size(F.array_distinct(b)))
    return F.when(least > 0, F.size(F.array_intersect(a, b)) / least).otherwise(1.0)


def weak_pairs(cited: DataFrame, texts: DataFrame, joining: DataFrame, linked: DataFrame, most: int = 3) -> DataFrame:
    """(query, a, b, via, ratio, graph_only, place): pairs of cited documents with the best bridge that joins both.

    cited(query, document) with few rows a query, texts(query, document, text) the passages used, joining the result of
    ``bridges``.  Pairs on topic come first, then those with the rarer bridge, then those with less vocabulary in common.
    """
    vocab = texts.groupBy("query", "document").agg(F.array_distinct(F.flatten(F.collect_list(content_tokens("text")))).alias("words"))
    held = joining.join(linked, "entity").join(cited.select("query", "document").distinct(), ["query", "document"]).join(vocab, ["query", "document"])
    a = held.select("query", "entity", "place", "on_topic", "reach", F.col("document").alias("a"), F.col("words").alias("wa"))
    b = held.select("query", "entity", F.col("document").alias("b"), F.col("words").alias("wb"))
    both = a.join(b, ["query", "entity"]).where("a < b")
    pairs = both.groupBy("query", "a", "b").agg(F.min_by(F.struct("entity", "on_topic", "reach", overlap_ratio("wa", "wb").alias("ratio")), "place").alias("x"))
    rows = pairs.select("query", "a", "b", F.col("x.entity").alias("via"), F.round("x.ratio", 6).alias("ratio"), (F.col("x.ratio") < GRAPH_ONLY).alias("graph_only"), F.col("x.on_topic").alias("t"), F.col("x.reach").alias("r"))
    order = W.partitionBy("query").orderBy(F.desc("t"), "r", "ratio", "a", "b")
    return rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).drop("t", "r")


def document_class(source_type: Column, domain: Column, name: Column) -> Column:
    """Regulatory record, regulatory filing or product documentation."""
    return F.when(source_type == "registry", "regulatory-record").when((domain == "Regulatory") | name.rlike(r"^K\d{6}"), "regulatory-filing").otherwise("product-documentation")


def citation_lineage(citations: DataFrame) -> DataFrame:
    """(query, document, citations, first): citations(query, pick, document) grouped by document in order of appearance."""
    return citations.groupBy("query", "document").agg(F.count("*").alias("citations"), F.min("pick").alias("first"))


def graph_purpose(linked: DataFrame, cross: DataFrame) -> DataFrame:
    """One row: entities, those of two documents or more, and those of several sources."""
    per = linked.groupBy("entity").agg(F.count("*").alias("n")).join(cross.select("entity", F.lit(1).alias("x")), "entity", "left")
    return per.agg(F.count("*").alias("entities"), F.count_if(F.col("n") > 1).alias("in_several_documents"), F.count_if(F.col("x") == 1).alias("cross_source"))


def estimated_domains(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row: the greater of the number of documents and of distinct top sections."""
    d = documents.agg(F.countDistinct("document_id").alias("d"))
    s = chunks.agg(F.countDistinct(F.get("section_path", F.lit(0))).alias("s"))
    return d.crossJoin(F.broadcast(s)).select(F.greatest("d", "s").alias("domains"))  # one row each


def demo_chunk(chunks: DataFrame, furniture: Column) -> DataFrame:
    """The first chunk fit to show: no furniture, longer than 80 characters, with a section; else the first of all."""
    fit = ~furniture & (F.length("text") > 80) & (F.size("section_path") > 0)
    best = chunks.select("chunk_id", F.coalesce(fit, F.lit(False)).alias("fit")).agg(F.coalesce(F.min(F.when(F.col("fit"), F.col("chunk_id"))), F.min("chunk_id")).alias("chunk_id"))
    return best.where("chunk_id IS NOT NULL")
