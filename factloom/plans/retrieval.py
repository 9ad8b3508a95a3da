"""Retrieval queries with their SQL: index tables, BM25, expansion, cosine, fusion and facets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import lexicons as L
from factloom.functions.text import degenerate, tokens
from factloom.operators.fusion import diagnostics, facet_counts, faceted, reciprocal_rank_fusion
from factloom.operators.lexical import LexicalIndex, bm25, expanded_terms, query_terms, shared_index, top_k, vocabulary
from factloom.operators.semantic import semantic_search, shared_semantic
from factloom.operators.vectors import cosine_top_k
from factloom.session import small, table

DEPTH = 20


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


def _items(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark_items")


def _index(spark: SparkSession, d: str) -> LexicalIndex:
    return shared_index(_docs(spark, d), "doc_id")


def tokenize_documents(spark, d):
    t = tokens("text")
    return _docs(spark, d).select("doc_id", F.size(t).alias("n_tokens"), F.size(F.array_distinct(t)).alias("n_distinct"))


def corpus_vocabulary(spark, d):
    return vocabulary(_docs(spark, d))


def bm25_terms(spark, d):
    return _index(spark, d).terms.select("term", "df", F.round("idf", 6).alias("idf"))


def bm25_corpus_stats(spark, d):
    return _index(spark, d).stats.select("n", F.round("avgdl", 6).alias("avgdl"))


def bm25_postings(spark, d):
    return _index(spark, d).postings.select(F.col("doc").alias("doc_id"), "term", "tf", "dl")


def _lexical(spark, d, k):
    return top_k(bm25(_index(spark, d), query_terms(_items(spark, d), "item_id", "text")), k)


def _coverage(spark, d, k):
    """Second retriever: share of a query's distinct terms that a document holds."""
    q = query_terms(_items(spark, d), "item_id", "text").select("query", "term")
    size = q.groupBy("query").agg(F.count("*").alias("n"))
    p = _index(spark, d).postings
    hits = p.join(small(q), "term").groupBy("query", "doc").agg(F.count("*").alias("hit"))
    return top_k(hits.join(small(size), "query").select("query", "doc", F.round(F.col("hit") / F.col("n"), 6).alias("score")), k)


def _latent(docs, asked, query, text, k):
    """Latent-semantic run of asked(query, text), a fixed question set, over the documents; empty where the index is disabled."""
    index = shared_semantic(docs, "doc_id")
    if not index.enabled:
        return docs.sparkSession.createDataFrame([], "query bigint, doc bigint, score double, rank int")
    return semantic_search(index, [(r[0], r[1]) for r in asked.select(query, text).collect()], k)


def _semantic(spark, d, k):
    return _latent(_docs(spark, d), _items(spark, d), "item_id", "text", k)


def bm25_search(spark, d):
    return _lexical(spark, d, DEPTH).select(F.col("query").alias("item_id"), F.col("doc").alias("doc_id"), "rank", "score")


def bm25_search_expanded(spark, d):
    index = _index(spark, d)
    synonyms = spark.createDataFrame([(a, b) for a, bs in L.SYNONYMS.items() for b in bs], "term string, variant string")
    weighted = expanded_terms(_items(spark, d), "item_id", "text", index.terms, synonyms)
    return top_k(bm25(index, weighted), DEPTH).select(F.col("query").alias("item_id"), F.col("doc").alias("doc_id"), "rank", "score")


def cosine_search(spark, d):
    v = table(spark, d, "embeddings")
    return cosine_top_k(v, v.where("vec_id % 20 = 0"), "vec_id", "embedding").select(F.col("query").alias("query_id"), F.col("doc").alias("vec_id"), "rank", "score")


def _fused(spark, d, second=_coverage, name="coverage"):
    run = lambda df, name: df.select("query", F.lit(name).alias("retriever"), "doc", "score", "rank", F.lit(1.0).alias("weight"))
    return reciprocal_rank_fusion(run(_lexical(spark, d, 40), "bm25").unionByName(run(second(spark, d, 40), name)))


def _ranked(fused):
    return top_k(fused, DEPTH).select(F.col("query").alias("item_id"), F.col("doc").alias("doc_id"), "rank", "score", "retrievers", "best_rank")


def _faceted(spark, d, fused):
    top = top_k(fused, 40).select("query", "doc", "score", F.col("rank").alias("fused_rank"))
    kept = faceted(top, _docs(spark, d), "doc_id", {"doc_type": "Instructions For Use", "lang": "all"})
    return top_k(kept, DEPTH).select(F.col("query").alias("item_id"), F.col("doc").alias("doc_id"), "rank", "fused_rank")


def rrf_fusion(spark, d):
    return _ranked(_fused(spark, d))


def hybrid_faceted(spark, d):
    return _faceted(spark, d, _fused(spark, d))


def hybrid_diagnostics(spark, d):
    return diagnostics(_lexical(spark, d, 20), _coverage(spark, d, 20)).withColumnRenamed("query", "item_id")


def rrf_fusion_semantic(spark, d):
    """BM25 fused with the latent-semantic run; an iterative method, so without SQL, as the two below."""
    return _ranked(_fused(spark, d, _semantic, "semantic"))


def hybrid_faceted_semantic(spark, d):
    return _faceted(spark, d, _fused(spark, d, _semantic, "semantic"))


def hybrid_diagnostics_semantic(spark, d):
    return diagnostics(_lexical(spark, d, 20), _semantic(spark, d, 20)).withColumnRenamed("query", "item_id")


def facets(spark, d):
    return facet_counts(_docs(spark, d), ["lang", "source", "doc_type", "product"])


def degenerate_queries(spark, d):
    return table(spark, d, "entity_mentions").select("name").distinct().select("name", degenerate("name").alias("degenerate"))


_TOK = "list_filter(list_transform(regexp_extract_all({0}, '[A-Za-z0-9]+'), lambda x: lower(x)), lambda x: length(x) > 1)"
_IDX = f"""
t AS (SELECT doc_id, {_TOK.format('text')} AS ts FROM documents), s AS (SELECT count(*) AS n, avg(len(ts)) AS avgdl FROM t),
p AS (SELECT doc_id, len(ts) AS dl, unnest(ts) AS term FROM t), po AS (SELECT doc_id, dl, term, count(*) AS tf FROM p GROUP BY ALL),
te AS (SELECT term, count(*) AS df, ln(1 + (any_value(n) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM po, s GROUP BY term),
qt AS (SELECT item_id, unnest({_TOK.format('text')}) AS term FROM benchmark_items), q AS (SELECT item_id, term, count(*)::DOUBLE AS w FROM qt GROUP BY ALL)
"""
_RANK = "row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank"
_BM = lambda q: f"""(SELECT item_id, doc_id, round(sum(w * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM {q} JOIN te USING (term) JOIN po USING (term), s GROUP BY ALL)"""
_RUNS = f""", a AS (SELECT item_id, doc_id, score, {_RANK} FROM {_BM('q')}), cs AS (SELECT item_id, count(*) AS n FROM q GROUP BY 1),
c AS (SELECT item_id, doc_id, score, {_RANK} FROM (SELECT q.item_id, doc_id, round(count(*) / any_value(cs.n), 6) AS score FROM q JOIN po USING (term) JOIN cs ON cs.item_id = q.item_id GROUP BY ALL))"""
_FUSE = _RUNS + f""", f AS (SELECT item_id, doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score, string_agg(r, '+' ORDER BY r) AS retrievers, min(rank) AS best_rank
FROM (SELECT *, 'bm25' AS r FROM a WHERE rank <= 40 UNION ALL SELECT *, 'coverage' FROM c WHERE rank <= 40) GROUP BY ALL), ff AS (SELECT *, {_RANK} FROM f)"""
_SYN = ", ".join(f"('{a}', '{b}')" for a, bs in L.SYNONYMS.items() for b in bs)
_STEM = "CASE " + " ".join(
    f"WHEN ends_with(term, '{e}'){' AND NOT ends_with(term, chr(115) || chr(115))' if e == 's' else ''} THEN CASE WHEN length(term) - {len(e)} >= 4 THEN left(term, length(term) - {len(e)}) ELSE term END" for e in ("ies", "ing", "ed", "er", "es", "s")) + " ELSE term END"
_FACET = " UNION ALL ".join(f"SELECT '{c}' AS dimension, {c} AS value FROM documents" for c in ("lang", "source", "doc_type", "product"))
_FW = ", ".join(f"'{w}'" for w in L.FUNCTION_WORDS)

QUERIES = {f.__name__: f for f in (
    tokenize_documents, corpus_vocabulary, bm25_terms, bm25_corpus_stats, bm25_postings, bm25_search, bm25_search_expanded, cosine_search, rrf_fusion, hybrid_faceted,
    hybrid_diagnostics, rrf_fusion_semantic, hybrid_faceted_semantic, hybrid_diagnostics_semantic, facets, degenerate_queries)}
SQL = {
    "tokenize_documents": f"SELECT doc_id, len(t) AS n_tokens, len(list_distinct(t)) AS n_distinct FROM (SELECT doc_id, {_TOK.format('text')} AS t FROM documents)",
    "corpus_vocabulary": "SELECT word, count(*) AS n FROM (SELECT unnest(list_transform(regexp_extract_all(text, '[A-Za-z]{2,}'), lambda x: lower(x))) AS word FROM documents) GROUP BY 1 HAVING count(*) >= 2",
    "bm25_terms": f"WITH {_IDX} SELECT term, df, round(idf, 6) AS idf FROM te",
    "bm25_corpus_stats": f"WITH {_IDX} SELECT n, round(avgdl, 6) AS avgdl FROM s",
    "bm25_postings": f"WITH {_IDX} SELECT doc_id, term, tf, dl FROM po",
    "bm25_search": f"WITH {_IDX} SELECT * FROM (SELECT item_id, doc_id, {_RANK}, score FROM {_BM('q')}) WHERE rank <= 20",
    "bm25_search_expanded": f"""WITH {_IDX}, st AS (SELECT DISTINCT term, {_STEM} AS prefix FROM q WHERE length(term) >= 4),
va AS (SELECT st.term, te.term AS variant, row_number() OVER (PARTITION BY st.term ORDER BY te.term) AS r FROM st JOIN te ON starts_with(te.term, prefix) AND length(te.term) <= length(prefix) + 5 AND te.term <> st.term),
sy AS (SELECT term, variant FROM (VALUES {_SYN}) AS v(term, variant) WHERE variant IN (SELECT term FROM te)),
ev AS (SELECT term, variant, max(w) AS w FROM (SELECT term, variant, 0.55::DOUBLE AS w FROM va WHERE r < 6 UNION ALL SELECT term, variant, 0.45 FROM sy) GROUP BY ALL),
qq AS (SELECT item_id, term, max(w) AS w FROM (SELECT * FROM q UNION ALL SELECT item_id, variant, q.w * ev.w FROM q JOIN ev USING (term)) GROUP BY ALL)
SELECT * FROM (SELECT item_id, doc_id, {_RANK}, score FROM {_BM('qq')}) WHERE rank <= 20""",
    "cosine_search": """SELECT * FROM (SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, score FROM (
SELECT q.vec_id AS query_id, v.vec_id, round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS score FROM embeddings q JOIN embeddings v ON q.vec_id % 20 = 0 AND q.vec_id <> v.vec_id)) WHERE rank <= 10""",
    "rrf_fusion": f"WITH {_IDX} {_FUSE} SELECT item_id, doc_id, rank, score, retrievers, best_rank FROM ff WHERE rank <= 20",
    "hybrid_faceted": f"""WITH {_IDX} {_FUSE} SELECT * FROM (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, rank AS fused_rank FROM ff
JOIN documents USING (doc_id) WHERE rank <= 40 AND doc_type = 'Instructions For Use') WHERE rank <= 20""",
    "hybrid_diagnostics": f"""WITH {_IDX} {_RUNS}, j AS (SELECT item_id, doc_id, max(x) AS x, max(y) AS y FROM (SELECT item_id, doc_id, 1 AS x, 0 AS y FROM a WHERE rank <= 10 UNION ALL SELECT item_id, doc_id, 0, 1 FROM c WHERE rank <= 10) GROUP BY ALL),
m AS (SELECT item_id, max(score) FILTER (rank = 1) AS top, avg(score) FILTER (rank BETWEEN 2 AND 5) AS rest FROM a GROUP BY 1)
SELECT item_id, round(sum(x * y) / count(*), 2) AS agreement, round(coalesce((any_value(top) - any_value(rest)) / any_value(top), 0.6), 4) AS margin FROM j LEFT JOIN m USING (item_id) GROUP BY 1""",
    "facets": f"SELECT dimension, value, n FROM (SELECT *, row_number() OVER (PARTITION BY dimension ORDER BY n DESC, value) AS r FROM (SELECT dimension, value, count(*) AS n FROM ({_FACET}) WHERE value <> '' GROUP BY ALL)) WHERE r <= 60",
    "degenerate_queries": f"SELECT DISTINCT name, coalesce(len(t) = 0 OR len(list_filter(t, lambda x: x NOT IN ({_FW}))) = 0, true) AS degenerate FROM (SELECT name, {_TOK.format('name')} AS t FROM entity_mentions)",
}
