"""Runs straight from the texts against the postings, and plans that stay small."""

import random

from pyspark.sql import functions as F

from factloom.operators import composition as C
from factloom.operators import direct as D
from factloom.operators.lexical import bm25, build_index, query_terms, top_k, vocabulary


def test_opener_holds_each_line_once(spark):
    said = C.opener(F.col("intent"), F.col("focus"), F.col("documents"))
    assert len(str(said)) < 30_000  # each of the twelve intents once doubled what stood before it
    rows = spark.createDataFrame([("CAUSAL", ["glucose"], 1), ("GENERAL", [], 2), ("UNHEARD", [], 1), (None, ["lactate", "meter"], 1)], "intent string, focus array<string>, documents int")
    assert [r[0] for r in rows.select(said).collect()] == [
        "On how Glucose relate, the documentation states:", "Here is what the documentation says about this — drawn from 2 documents:", "Here is what the documentation says about this:", "Here is what the documentation says about Lactate:"]


def test_sentences_at_one_place_are_read_by_chunk(spark):
    rows = [(1, i + 1, chunk, 7, 4, 0.5, f"chunk {chunk}") for i, chunk in enumerate((9, 3, 8, 2, 6))]
    read = C.reading_order(spark.createDataFrame(rows, "query int, pick int, chunk int, document int, position int, final double, sentence string")).orderBy("pick").collect()
    assert [r.chunk for r in read] == [2, 3, 6, 8, 9]


def test_direct_runs_equal_the_postings(spark, monkeypatch):
    monkeypatch.setattr(D, "_CELLS", 600)
    monkeypatch.setattr(D, "_GROUP", 4)
    rnd = random.Random(5)
    words = [f"w{i}" for i in range(25)] + ["Straße", "naïve", "x", "Kelvin", "A1b2"]
    texts = [(i, " ".join(rnd.choices(words, k=rnd.randint(0, 12)))) for i in range(400)] + [(400, None), (401, ""), (7, None), (None, "w1 w2"), (402, "w3 w4 w5"), (403, "w3 w4 w5"), (404, "w3 w4 w5")]
    docs = spark.createDataFrame(texts, "doc bigint, text string").where("NOT (doc = 7 AND text IS NULL)")
    docs = docs.unionByName(docs.where("doc % 5 = 0")).repartition(3)
    asked = query_terms(spark.createDataFrame([(q, " ".join(rnd.choices([*words, "unheard"], k=6))) for q in range(11)] + [(11, "unheard"), (12, "w3 w3 w4 w5")], "query int, text string"), "query", "text")
    index, of = build_index(docs, "doc"), D.figures(docs, "doc")
    assert (of.n, of.avgdl) == tuple(index.stats.first())
    assert {(r.term, r.df) for r in of.terms.collect()} == {(r.term, r.df) for r in index.terms.collect()}
    assert {tuple(r) for r in of.words.where("n >= 2").collect()} == {tuple(r) for r in vocabulary(docs.dropDuplicates(["doc"])).collect()}
    runs = D.direct_runs(docs, "doc", asked, of, 9)
    rows = lambda df: {tuple(r) for r in df.select("query", "doc", "score", "rank").collect()}
    assert rows(top_k(runs.where("run = 'bm25'"), 9)) == rows(top_k(bm25(index, asked), 9))
    held = index.postings.join(asked, "term").groupBy("query", "doc").agg(F.count("*").cast("double").alias("score"))
    assert rows(top_k(runs.where("run = 'hits'"), 9)) == rows(top_k(held, 9))
    assert D.direct_runs(docs.where("doc > 900"), "doc", asked, D.figures(docs.where("doc > 900"), "doc"), 9).count() == 0


def test_counts_are_handed_on_before_memory_fills(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"w{i % 50} Both w{i % 7}x") for i in range(300)], "doc int, text string")
    whole = {tuple(r) for r in D.figures(docs, "doc").terms.collect()}
    monkeypatch.setattr(D, "_TERMS", 10)
    monkeypatch.setattr(D, "_ROWS", 16)
    again = D.figures(docs, "doc")
    assert {tuple(r) for r in again.terms.collect()} == whole and (again.n, again.avgdl) == (300, 3.0)


def test_once_keeps_one_row_of_each_key(spark):
    rows = [(1, "a"), (1, "a"), (2, "b"), (None, "c"), (None, "c"), (3, None)]
    df = spark.createDataFrame(rows, "k int, t string")
    assert sorted(map(str, D.once(df, "k").collect())) == sorted(map(str, df.dropDuplicates(["k"]).collect()))
    assert D.once(df.where("k > 1"), "k").count() == 2
