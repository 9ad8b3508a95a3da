"""Property graph over knowledge records: events, nodes, edges, bridges, traces and paths.

Each record yields its node and edge events in one projection (no join); nodes and edges are
aggregations of events with multiset counts, so no event may be deduplicated before counting.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factloom.functions import lexicons as L
from factloom.session import small

NAME_CHARS, CHUNKS, EVIDENCE, EDGES, CITED = 120, 60, 12, 4000, 4
K_NUMBER = r"\bK[0-9]{6,9}\b"


def _key(kind: Column | str, name: Column) -> Column:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    clean = F.trim(name)
    return F.when((clean != "") & (F.length(clean) <= NAME_CHARS), F.concat(kind, F.lit(":"), F.lower(clean)))


@dataclass
class Events:
    """nodes(chunk, source, key, kind, name, pos) and edges(chunk, a, b, type), one row per occurrence."""

    nodes: DataFrame
    edges: DataFrame


def graph_events(records: DataFrame, analytes: dict[str, str] = L.ANALYTES) -> Events:
    """Events of records(source_id, source_type, text, metadata, entities), one record per source_id.

    Null parts give no event.  A record's products are its Product entities; a product named twice counts twice.
    """
    m = lambda k: F.col("metadata")[k]
    kind_is = lambda *k: F.coalesce(m("record_type").isin(*k), F.lit(False))
    entities = F.filter(F.coalesce("entities", F.array().cast("array<struct<kind:string,name:string>>")), lambda e: e["kind"].isNotNull() & e["name"].isNotNull())
    named = F.transform(F.filter(entities, lambda e: e["kind"] == "Product"), lambda e: e["name"])
    doc = F.coalesce(m("document_name"), F.col("title"))
    documented = kind_is("ifu_catalogue", "document_paragraph")
    products = F.filter(named, lambda p: _key("Product", p).isNotNull())
    low = F.lower("text")
    spoken = F.array_distinct(F.array_compact(F.array(*[F.when(low.rlike(rf"\b{t}\b"), F.lit(a)) for t, a in analytes.items()])))
    cited = F.slice(F.regexp_extract_all("text", F.lit(f"({K_NUMBER})"), 1), 1, CITED)
    reg = F.get(F.transform(F.filter(entities, lambda e: e["kind"] == "Regulation"), lambda e: e["name"]), 0)
    node = lambda kind, name: F.struct(F.lit(kind).alias("kind"), name.alias("name"))
    one = lambda test, *nodes: F.when(test, F.array(*nodes)).otherwise(F.array().cast("array<struct<kind:string,name:string>>"))
    nodes = F.concat(
        entities, one(kind_is("clearance"), node("Clearance", m("k_number")), node("ProductCode", m("product_code"))),
        one(kind_is("classification"), node("ProductCode", m("product_code")), node("Regulation", reg)), one(kind_is("recall"), node("Recall", m("recall_number")), node("ProductCode", m("product_code"))),
        one(documented, node("Document", doc)), F.transform(spoken, lambda a: node("Analyte", a)), F.transform(cited, lambda k: node("Clearance", k)),
    )
    edge = lambda a, b, t: F.struct(a.alias("a"), b.alias("b"), F.lit(t).alias("type"))
    several = lambda test, *e: F.when(test, F.array(*e)).otherwise(F.array().cast("array<struct<a:string,b:string,type:string>>"))
    each = lambda test, f: F.when(test, F.transform(products, f)).otherwise(F.array().cast("array<struct<a:string,b:string,type:string>>"))
    k, code, recall = _key("Clearance", m("k_number")), _key("ProductCode", m("product_code")), _key("Recall", m("recall_number"))
    edges = F.concat(
        several(kind_is("clearance"), edge(k, code, "GOVERNED_BY")), each(kind_is("clearance"), lambda p: edge(_key("Product", p), k, "CLEARED_UNDER")),
        several(kind_is("classification"), edge(code, _key("Regulation", reg), "CLASSIFIED_UNDER")), several(kind_is("recall"), edge(recall, code, "GOVERNED_BY")),
        each(kind_is("recall"), lambda p: edge(recall, _key("Product", p), "RECALL_AFFECTS")), each(documented, lambda p: edge(_key("Product", p), _key("Document", doc), "DOCUMENTED_IN")),
        F.flatten(F.transform(products, lambda p: F.transform(spoken, lambda a: edge(_key("Product", p), _key("Analyte", a), "MEASURES")))),
        F.flatten(F.transform(products, lambda p: F.transform(cited, lambda c: edge(_key("Product", p), _key("Clearance", c), "CLEARED_UNDER")))),
    )
    base = records.select(F.col("source_id").alias("chunk"), F.col("source_type").alias("source"), nodes.alias("ns"), edges.alias("es"))
    n = base.select("chunk", "source", F.posexplode("ns").alias("pos", "n")).select("chunk", "source", "pos", "n.kind", "n.name", _key(F.col("n.kind"), F.col("n.name")).alias("key")).where("key IS NOT NULL")
    e = base.select("chunk", F.explode("es").alias("e")).select("chunk", "e.*").where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    return Events(n, e)


def canonical_products(records: DataFrame, aliases: DataFrame) -> DataFrame:
    """Records whose Product entities are those that aliases(alias, product) find as words of their device or product name.

    Other Product entities are dropped; a name may hold several products.  Names meet aliases in an equi-join on words.
    """
    name = F.lower(F.coalesce(F.col("metadata")["device_name"], F.col("metadata")["product"]))
    said = records.select("source_id", F.explode(F.array_distinct(F.split(name, "[^a-z0-9]+"))).alias("alias"))
    found = said.join(small(aliases), "alias").groupBy("source_id").agg(F.array_sort(F.collect_set("product")).alias("found"))  # one record's products
    rest = F.filter(F.coalesce("entities", F.array().cast("array<struct<kind:string,name:string>>")), lambda e: e["kind"] != "Product")
    named = F.transform(F.coalesce("found", F.array().cast("array<string>")), lambda p: F.struct(F.lit("Product").alias("kind"), p.alias("name")))
    return records.join(found, "source_id", "left").withColumn("entities", F.concat(rest, named)).drop("found")


def graph_edges(events: Events, most: int | None = EDGES) -> DataFrame:
    """(a, b, type, weight, evidence): weight counts events, evidence distinct records up to EVIDENCE; the heaviest ``most``."""
    out = events.edges.groupBy("a", "b", "type").agg(F.count("*").alias("weight"), F.least(F.countDistinct("chunk"), F.lit(EVIDENCE)).alias("evidence"))
    return out.orderBy(F.desc("weight"), "a", "b", "type").limit(most) if most else out


def graph_nodes(events: Events, edges: DataFrame, least: int = 3) -> DataFrame:
    """(key, kind, mentions, chunks, sources, degree, cross_source) of endpoints of kept edges and of nodes with ``least`` mentions."""
    degree = edges.select(F.col("a").alias("key")).unionAll(edges.select(F.col("b").alias("key"))).groupBy("key").agg(F.count("*").alias("degree"))
    nodes = events.nodes.groupBy("key").agg(F.min("kind").alias("kind"), F.count("*").alias("mentions"), F.least(F.countDistinct("chunk"), F.lit(CHUNKS)).alias("chunks"), F.countDistinct("source").alias("sources"))
    kept = nodes.join(degree, "key", "left").where(F.col("degree").isNotNull() | (F.col("mentions") >= least))
    return kept.select("key", "kind", "mentions", "chunks", "sources", F.coalesce("degree", F.lit(0)).alias("degree"), ((F.col("kind") == "Product") & (F.col("sources") >= 2)).alias("cross_source"))


def node_lists(events: Events, most: int = CHUNKS) -> DataFrame:
    """(key, name, chunks, sources): a node's name as first written, its first ``most`` records and its sources, in order.

    Records are deduplicated and ranked before they are gathered, so a hot node's list never exceeds ``most``.
    """
    each = events.nodes.groupBy("key", "chunk").agg(F.min(F.struct("pos", "name")).alias("said"))
    ranked = each.withColumn("r", F.row_number().over(W.partitionBy("key").orderBy("chunk"))).where(F.col("r") <= most)
    lists = ranked.groupBy("key").agg(F.min_by("said.name", "r").alias("name"), F.array_sort(F.collect_list("chunk")).alias("chunks"))
    seen = events.nodes.groupBy("key", "source").agg(F.lit(1).alias("one")).groupBy("key").agg(F.array_sort(F.collect_list("source")).alias("sources"))  # source systems are few
    return lists.join(seen, "key")


def edge_evidence(events: Events, most: int = EVIDENCE) -> DataFrame:
    """(a, b, type, chunks): the first ``most`` records in order that state an edge."""
    each = events.edges.select("a", "b", "type", "chunk").distinct()
    ranked = each.withColumn("r", F.row_number().over(W.partitionBy("a", "b", "type").orderBy("chunk"))).where(F.col("r") <= most)
    return ranked.groupBy("a", "b", "type").agg(F.array_sort(F.collect_list("chunk")).alias("chunks"))


def node_documents(events: Events, documents: DataFrame) -> DataFrame:
    """(key, document): the documents of a node's records; records without a known document(chunk, document) are left out."""
    return events.nodes.select("key", "chunk").distinct().join(documents, "chunk").select("key", "document").distinct()


def graph_stats(events: Events, edges: DataFrame) -> DataFrame:
    """(metric, value): all nodes, kept edges, cross-source products, and edges by type."""
    nodes = events.nodes.groupBy("key").agg(F.min("kind").alias("kind"), F.countDistinct("source").alias("s"))
    one = lambda name, df: df.select(F.lit(name).alias("metric"), F.col("n").alias("value"))
    return (
        one("node_count", nodes.agg(F.count("*").alias("n"))).unionAll(one("edge_count", edges.agg(F.count("*").alias("n"))))
        .unionAll(one("cross_source_products", nodes.agg(F.count_if((F.col("kind") == "Product") & (F.col("s") >= 2)).alias("n"))))
        .unionAll(edges.groupBy("type").agg(F.count("*").alias("value")).select(F.concat(F.lit("edges:"), "type").alias("metric"), "value"))
    )


def trace_one_hop(edges: DataFrame, active: DataFrame) -> DataFrame:
    """(a, b, type, neighbour): edges that touch the active keys; two equi-joins instead of an OR, each edge once."""
    on = lambda c: edges.join(active.select(F.col("key").alias(c)), c, "left_semi").select("a", "b", "type")
    touched = on("a").unionAll(on("b")).distinct()
    mark = active.select(F.col("key").alias("k"), F.lit(True).alias("on"))
    both = touched.join(mark.withColumnsRenamed({"k": "a", "on": "a_on"}), "a", "left").join(mark.withColumnsRenamed({"k": "b", "on": "b_on"}), "b", "left")
    return both.select("a", "b", "type", F.when(F.col("a_on").isNull(), F.col("a")).when(F.col("b_on").isNull(), F.col("b")).alias("neighbour"))


def reachable_regulations(edges: DataFrame) -> DataFrame:
    """(product, regulation, clearances): products to regulations over clearance and code, paths counted by clearance."""
    hop = lambda t, a, b: edges.where(F.col("type") == t).select(F.col("a").alias(a), F.col("b").alias(b)).distinct()
    return (
        hop("CLEARED_UNDER", "product", "clearance").join(hop("GOVERNED_BY", "clearance", "code"), "clearance").join(hop("CLASSIFIED_UNDER", "code", "regulation"), "code")
        .groupBy("product", "regulation").agg(F.countDistinct("clearance").alias("clearances"))
    )


def neighbours(edges: DataFrame, most: int = 8) -> DataFrame:
    """(key, neighbour, type, weight): the heaviest neighbours of every node, in both directions."""
    both = edges.select(F.col("a").alias("key"), F.col("b").alias("neighbour"), "type", "weight").unionAll(edges.select(F.col("b").alias("key"), F.col("a").alias("neighbour"), "type", "weight"))
    order = W.partitionBy("key").orderBy(F.desc("weight"), "neighbour", "type")
    return both.withColumn("r", F.row_number().over(order)).where(F.col("r") <= most).drop("r")


# --- entities of free text


def entity_table(mentions: DataFrame) -> DataFrame:
    """(canonical, kind, mentions, chunks, documents) of entities named twice or written as an acronym."""
    base = mentions.select(F.lower(F.trim("canonical")).alias("canonical"), F.trim("name").alias("name"), "kind", "mention_id", "chunk_id", "document_id").where("canonical <> ''").dropDuplicates(["mention_id"])
    out = base.groupBy("canonical").agg(
        F.min_by("kind", "mention_id").alias("kind"), F.count("*").alias("mentions"), F.countDistinct("chunk_id").alias("chunks"), F.countDistinct("document_id").alias("documents"),
        F.max(F.col("name").rlike("^[A-Z]{2,6}$")).alias("acronym"))
    return out.where((F.col("mentions") >= 2) | F.col("acronym")).drop("acronym")


def cooccurring(mentions: DataFrame, basket: str, item: str, least: int = 2, block: int = 64) -> DataFrame:
    """(a, b, weight) of items that share at least ``least`` baskets; large baskets are spread in blocks.

    Items found in fewer than ``least`` baskets are dropped before any pair exists.
    """
    marks = mentions.select(F.col(basket).alias("k"), F.lower(F.trim(F.col(item))).alias("i")).where("k IS NOT NULL AND i <> ''").distinct()
    often = marks.groupBy("i").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("i")
    baskets = marks.join(often, "i", "left_semi").groupBy("k").agg(F.array_sort(F.collect_list("i")).alias("items")).where(F.size("items") > 1)
    blocks = baskets.select("k", "items", F.explode(F.sequence(F.lit(0), F.floor((F.size("items") - 1) / block).cast("int"))).alias("j"))
    spread = blocks.where(F.size("items") <= block).unionByName(blocks.where(F.size("items") > block).repartition("k", "j"))
    heads = spread.select("items", "j", F.posexplode(F.slice("items", F.col("j") * block + 1, block)).alias("p", "a"))
    pairs = heads.select("a", F.explode(F.slice("items", F.col("j") * block + F.col("p") + 2, F.size("items"))).alias("b"))
    return pairs.groupBy("a", "b").agg(F.count("*").alias("weight")).where(F.col("weight") >= least)


def isolated_documents(mentions: DataFrame) -> DataFrame:
    """Documents none of whose entities occurs in another document (anti-join)."""
    base = mentions.select(F.lower(F.trim("canonical")).alias("c"), "document_id").where("c <> '' AND document_id IS NOT NULL").distinct()
    shared = base.groupBy("c").agg(F.count("*").alias("n")).where("n >= 2").select("c")
    linked = base.join(shared, "c", "left_semi").select("document_id").distinct()
    return base.select("document_id").distinct().join(linked, "document_id", "left_anti")
