"""Inverted index and BM25 retrieval over DataFrames of documents and queries.

Term counts combine map-side before the one shuffle on (document, term), and the postings are written
once.  A batch of queries is scored at once: the query terms, with their idf, meet the written postings,
the rows of other terms are skipped in the scan, and only partial sums per (query, document) are shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factloom.functions.text import stem_prefix, tokens, words
from factloom.session import small, stored

K1, B = 1.5, 0.75


@dataclass
class LexicalIndex:
    """postings(doc, dl, term, tf), terms(term, df, idf), the one-row stats(n, avgdl) and the postings as written."""

    postings: DataFrame
    terms: DataFrame
    stats: DataFrame
    written: DataFrame


def build_index(docs: DataFrame, doc: str, text: str = "text") -> LexicalIndex:
    """Index of docs, written to the shared folder once; repeated rows of a document count once, an empty corpus gives no scores.

    Every text is tokenised once.  Postings are written sorted by term within their files, so that a batch of
    queries reads only the row groups of its terms; terms and corpus figures are counted from the written postings.
    """
    rows = docs.select(F.col(doc).alias("doc"), F.col(text).alias("text")).where("doc IS NOT NULL")
    if rows.groupBy("doc").agg(F.count("*").alias("n")).where("n > 1").limit(1).count():  # reads ids only; texts are shuffled only if rows repeat
        rows = rows.dropDuplicates(["doc"])
    each = rows.select("doc", F.coalesce(tokens("text"), F.array().cast("array<string>")).alias("ts"))
    flat = each.select("doc", F.size("ts").alias("dl"), F.posexplode_outer("ts").alias("pos", "term"))
    counted = flat.groupBy("doc", "dl", "term").agg(F.count("term").alias("tf"), (F.coalesce(F.min("pos"), F.lit(0)) == 0).alias("first"))
    return _opened(stored(counted.sortWithinPartitions("term"), "lexical-postings"))


def _opened(written: DataFrame) -> LexicalIndex:
    """The three tables from written postings, in which each document has one row marked first."""
    stats = stored(written.where("first").agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl")), "lexical-stats")
    terms = (
        written.where("term IS NOT NULL").groupBy("term").agg(F.count("*").alias("df")).crossJoin(F.broadcast(stats.select("n")))  # one row
        .select("term", "df", F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    )
    return LexicalIndex(written.where("term IS NOT NULL").select("doc", "dl", "term", "tf"), stored(terms, "lexical-terms"), stats, written)


def save_index(index: LexicalIndex, path: str) -> None:
    """Writes an index to a folder for later sessions."""
    for name, df in (("written", index.written), ("terms", index.terms), ("stats", index.stats)):
        df.write.mode("overwrite").parquet(f"{path.rstrip('/')}/{name}")


def load_index(spark: SparkSession, path: str) -> LexicalIndex | None:
    """A saved index, or None where the folder holds none."""
    try:
        written, terms, stats = (spark.read.parquet(f"{path.rstrip('/')}/{name}") for name in ("written", "terms", "stats"))
    except AnalysisException:
        return None
    return LexicalIndex(written.where("term IS NOT NULL").select("doc", "dl", "term", "tf"), terms, stats, written)


def table_version(docs: DataFrame, *more: str) -> tuple:
    """What identifies a frame read from files: application, plan, files, their sizes and times; empty without files."""
    spark = docs.sparkSession
    conf, files = spark.sparkContext._jsc.hadoopConfiguration(), []
    for f in sorted(docs.inputFiles()):
        there = spark._jvm.org.apache.hadoop.fs.Path(f)
        state = there.getFileSystem(conf).getFileStatus(there)
        files.append((f, state.getLen(), state.getModificationTime()))
    return (spark.sparkContext.applicationId, *more, tuple(files), docs._jdf.queryExecution().analyzed().canonicalized().hashCode()) if files else ()


_indexes: dict[tuple, LexicalIndex] = {}


def shared_index(docs: DataFrame, doc: str, text: str = "text") -> LexicalIndex:
    """The index of a table read from files, built once per application and version of the files."""
    key = table_version(docs, doc, text)
    if not key:
        return build_index(docs, doc, text)
    if key not in _indexes:
        _indexes[key] = build_index(docs, doc, text)
    return _indexes[key]


def vocabulary(docs: DataFrame, text: str = "text", least: int = 2) -> DataFrame:
    """(word, n) of the words that occur at least ``least`` times."""
    return docs.select(F.explode(words(text)).alias("word")).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def query_terms(queries: DataFrame, query: str, text: str) -> DataFrame:
    """(query, term, weight): how often each term stands in a query."""
    return queries.select(F.col(query).alias("query"), F.explode(tokens(text)).alias("term")).groupBy("query", "term").agg(F.count("*").cast("double").alias("weight"))


def bm25(index: LexicalIndex, weighted: DataFrame, k1: float = K1, b: float = B) -> DataFrame:
    """(query, doc, score) of all documents that share a term with a query."""
    asked = stored(weighted.join(index.terms.select("term", "idf"), "term"), "query-terms")
    n, avgdl = index.stats.first()
    scored = index.postings.join(small(asked), "term").select(
        "query", "doc", (F.col("weight") * F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.lit(avgdl or 1.0)))).alias("part"))
    return scored.groupBy("query", "doc").agg(F.round(F.sum("part"), 6).alias("score"))


def top_k(scored: DataFrame, k: int, by: list[str] = ["query"], doc: str = "doc") -> DataFrame:  # noqa: B006
    """Best k rows per query with their rank; ties go to the smaller document.

    Spark keeps the k best of each task before the shuffle, as rank is compared with a constant.
    """
    order = W.partitionBy(*by).orderBy(F.desc("score"), F.col(doc))
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def expanded_terms(queries: DataFrame, query: str, text: str, terms: DataFrame, synonyms: DataFrame, morph: float = 0.55, synonym: float = 0.45, most: int = 6, slack: int = 5) -> DataFrame:
    """Weighted query terms with variants that share a stem and with synonyms, both only if indexed.

    A term of four characters or more also stands for the first ``most`` - 1 index terms, in order, that begin with its stem
    prefix and are at most ``slack`` characters longer than it.  The greatest weight of a (query, term) counts once per
    occurrence of the typed term.
    """
    typed = query_terms(queries, query, text)
    stems = typed.select("term").distinct().where(F.length("term") >= 4).select("term", stem_prefix(F.col("term")).alias("prefix"))
    # equi-join on the first four characters, then the exact prefix test
    listed = terms.select(F.col("term").alias("variant"), F.substring("term", 1, 4).alias("head"))
    variants = (
        listed.join(small(stems.withColumn("head", F.substring("prefix", 1, 4))), "head")
        .where(F.col("variant").startswith(F.col("prefix")) & (F.length("variant") <= F.length("prefix") + slack) & (F.col("variant") != F.col("term")))
        .withColumn("r", F.row_number().over(W.partitionBy("term").orderBy("variant"))).where(F.col("r") < most)
        .select("term", "variant", F.lit(morph).alias("w"))
    )
    other = synonyms.join(terms.select(F.col("term").alias("variant")), "variant", "left_semi").select("term", "variant", F.lit(synonym).alias("w"))
    every = variants.unionByName(other).groupBy("term", "variant").agg(F.max("w").alias("w"))
    widened = typed.join(every, "term").select("query", F.col("variant").alias("term"), (F.col("weight") * F.col("w")).alias("weight"))
    return typed.unionByName(widened).groupBy("query", "term").agg(F.max("weight").alias("weight"))
