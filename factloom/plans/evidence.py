"""Queries on what surrounds an answer: graph contribution, extraction, composition, gold matchers, file names; with SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.functions import lexicons as L
from factloom.functions.text import boilerplate_section, classify_sentence, content_tokens, name_tokens
from factloom.operators import answers as A
from factloom.operators import composition as C
from factloom.operators import evaluation as E
from factloom.operators import extraction as N
from factloom.operators import health as H
from factloom.operators import lineage as X
from factloom.operators.direct import once
from factloom.operators.fusion import explained
from factloom.operators.lexical import bm25, query_terms, shared_index, top_k
from factloom.operators.structure import dated, document_lines
from factloom.plans.answers import _EV, _MEAN, _answers, _chunks, _items, _line_quality, _runs, _signals
from factloom.plans.retrieval import _BM, _FUSE, _IDX, _TOK, _coverage, _index, _lexical
from factloom.plans.structure import SQL as STRUCTURE_SQL
from factloom.plans.structure import line_grades
from factloom.session import small, stored, table
from factloom.sources.connectors import file_doc_type, file_k_number, file_product
from factloom.sources.verbalise import severity_signal

PRODUCTS = (("meter", "Meter"), ("analyzer", "Analyzer"), ("strip", "Strip"), ("control", "Control"), ("cartridge", "Cartridge"))


def _mentions(spark, d):
    return table(spark, d, "entity_mentions")


def chunk_entities(spark, d):
    return X.chunk_entities(_mentions(spark, d)).select(F.col("chunk").alias("chunk_id"), F.array_join("entities", "|").alias("entities"))


def entity_documents(spark, d):
    return X.entity_documents(_mentions(spark, d)).withColumnsRenamed({"entity": "canonical", "document": "document_id"})


def _cross(spark, d):
    """Entities that chunks of several source systems name."""
    systems = _chunks(spark, d).select("chunk_id", "source_system").where("source_system IS NOT NULL")
    named = _mentions(spark, d).select(F.lower(F.trim("canonical")).alias("entity"), "chunk_id").where("entity <> ''").distinct()
    return named.join(systems, "chunk_id").groupBy("entity").agg(F.countDistinct("source_system").alias("n")).where("n > 1").select("entity")


def graph_purpose(spark, d):
    return X.graph_purpose(X.entity_documents(_mentions(spark, d)), _cross(spark, d))


def _cited(spark, d):
    """The six best chunks of each question with their documents."""
    chunks = _chunks(spark, d)
    hits = top_k(bm25(shared_index(_chunks(spark, d), "chunk_id"), query_terms(_items(spark, d), "item_id", "text")), 6)
    return stored(hits.join(chunks.select(F.col("chunk_id").alias("doc"), F.col("document_id").alias("document"), "text"), "doc"), "cited-chunks")


def _bridges(spark, d, cited):
    linked = X.entity_documents(_mentions(spark, d)).select("entity", "document")
    focus = _items(spark, d).select(F.col("item_id").alias("query"), A.focus_of("text").alias("focus"))
    documents = _chunks(spark, d).agg(F.countDistinct("document_id")).first()[0]
    return X.bridges(cited, linked, documents, focus, _cross(spark, d)), linked


def graph_bridges(spark, d):
    return _bridges(spark, d, _cited(spark, d))[0].withColumnRenamed("query", "item_id")


def graph_weak_pairs(spark, d):
    cited = _cited(spark, d)
    joining, linked = _bridges(spark, d, cited)
    return X.weak_pairs(cited, cited, joining, linked).withColumnRenamed("query", "item_id")


def citation_lineage(spark, d):
    return X.citation_lineage(_cited(spark, d).select("query", F.col("rank").alias("pick"), "document")).withColumnsRenamed({"query": "item_id", "document": "document_id"})


def estimated_domains(spark, d):
    c = _chunks(spark, d)
    return X.estimated_domains(c, c)


def demo_chunk(spark, d):
    return X.demo_chunk(table(spark, d, "chunks"), boilerplate_section("section_path"))


def extracted_entities(spark, d):
    return N.extracted_entities(_chunks(spark, d), "chunk_id")


def rrf_explained(spark, d):
    run = lambda df, name: df.select("query", F.lit(name).alias("retriever"), "doc", "score", "rank", F.lit(1.0).alias("weight"))
    runs = run(_lexical(spark, d, 40), "bm25").unionByName(run(_coverage(spark, d, 40), "coverage"))
    return explained(runs).select(F.col("query").alias("item_id"), F.col("doc").alias("doc_id"), "score", "explanation")


def rare_term_gate(spark, d):
    """Variants of unknown terms come from the index as in the expansion of queries."""
    index, items = _index(spark, d), _items(spark, d)
    n = index.stats.first()["n"]
    return A.rare_terms(query_terms(items, "item_id", "text"), index.terms, n).withColumnRenamed("query", "item_id")


def cohered_hits(spark, d):
    chunks, items = _chunks(spark, d), _items(spark, d)
    index = shared_index(_chunks(spark, d), "chunk_id")
    asked = query_terms(items, "item_id", "text")
    hits = top_k(bm25(index, asked), 20).join(chunks.select(
        F.col("chunk_id").alias("doc"), F.col("document_name").alias("document"), name_tokens("document_name").alias("name_tokens"), boilerplate_section("section_path").alias("furniture")), "doc")
    questions = items.select(F.col("item_id").alias("query"), F.array_distinct(content_tokens("text")).alias("terms"))
    rare = A.rare_terms(asked, index.terms, index.stats.first()["n"])
    return A.cohered(hits, questions, rare).withColumnsRenamed({"query": "item_id", "doc": "chunk_id"})


def file_name_facts(spark, d):
    names = table(spark, d, "chunks").select("document_name").where("document_name IS NOT NULL").distinct()
    return names.select("document_name", file_product("document_name", PRODUCTS).alias("product"), file_doc_type("document_name").alias("doc_type"), file_k_number("document_name").alias("k_number"))


def recall_severity(spark, d):
    return table(spark, d, "enforcement_reports").select("recall_number", severity_signal("reason_for_recall").alias("severity")).distinct()


def suggested_questions(spark, d):
    return C.suggested_questions(table(spark, d, "chunks"))


def health_extraction_quality(spark, d):
    c = _chunks(spark, d)
    graded = document_lines(c, "chunk_id").withColumn("g", classify_sentence("line", 3)).select(F.col("g.kind").alias("kind"))
    return H.extraction_quality(graded, _line_quality(c, "chunk_id"))


def health_dating_methods(spark, d):
    return H.dating_methods(table(spark, d, "documents").select(dated(F.lit(None).cast("string"), F.col("text"))["method"].alias("method")))


def _gold(spark, d):
    """Cases from the reference list: each name asks for its product or its brand in the text; strips need both met."""
    asked = table(spark, d, "device_reference").select(F.col("ref_id").alias("query"), F.col("canonical_name").alias("text"), "family")
    brand = F.get(F.split("text", " "), F.lit(1))
    rules = F.array(F.struct(F.lit(0).alias("matcher"), F.lit("product").alias("field"), F.array("text").alias("wanted")), F.struct(F.lit(1).alias("matcher"), F.lit("text_contains").alias("field"), F.array(brand).alias("wanted")))
    cases = asked.select("query", F.when(F.col("family") == "Strip", "all").otherwise("any").alias("kind"), F.lit(2).alias("matchers"))
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("doc"), "text", F.create_map(F.lit("product"), F.col("product")).alias("fields"))
    ranked = stored(top_k(bm25(_index(spark, d), query_terms(asked, "query", "text")), 10), "gold-hits")
    used = docs.join(ranked.select("doc").distinct(), "doc", "left_semi")
    return E.scored_cases(ranked, E.matcher_hits(ranked, used, asked.select("query", F.inline(rules))), cases)


def evaluation_gold_cases(spark, d):
    return _gold(spark, d).withColumnRenamed("query", "ref_id")


def evaluation_uplift(spark, d):
    return E.uplift(E.mean_metrics(_runs(spark, d)[0], ["mode"]))


def evaluation_weak_cases(spark, d):
    return E.weak_cases(_runs(spark, d)[0]).withColumnRenamed("query", "ref_id")


def clean_sentences(spark, d):
    lines = document_lines(_chunks(spark, d), "chunk_id")
    return lines.select(F.col("doc").alias("chunk_id"), "line_no", C.clean_sentence("line").alias("sentence"))


def composed_replies(spark, d):
    """Picked sentences in reading order with markers and source numbers, an opener above and a closing below."""
    picks = stored(_answers(spark, d), "reply-sentences")
    cited = once(table(spark, d, "chunks"), "chunk_id").select(F.col("chunk_id").alias("doc"), F.col("document_id").alias("document")).join(small(picks.select("doc").distinct()), "doc", "left_semi")
    picks = picks.join(cited, "doc")
    placed = stored(C.reading_order(picks.withColumnsRenamed({"doc": "chunk", "pos": "position"})), "reply-picks")
    questions = stored(_items(spark, d).select(F.col("item_id").alias("query"), A.intent_of("text").alias("intent"), A.focus_of("text").alias("focus")), "reply-questions")
    rows, signals = _signals(spark, d)
    percent, _ = A.confidence(signals, F.col("sources") == 0)
    last = rows.select("query", C.closing(percent, signals["consensus"], signals["coverage"], F.lit(0)).alias("closing"))
    said = C.composed_reply(placed, questions).join(last, "query", "left").withColumn("answered", F.lit(True))
    silent = questions.join(placed.select("query").distinct(), "query", "left_anti").select("query", C.no_answer(F.col("intent"), F.col("focus"), F.lit(0), F.lit(None).cast("string")).alias("opener"), F.lit("").alias("body"), F.lit(0).cast("bigint").alias("documents"), F.lit(None).cast("string").alias("closing"), F.lit(False).alias("answered"))
    return said.unionByName(silent).withColumnRenamed("query", "item_id")


def question_retry(spark, d):
    """Each question against the other benchmark questions as its bank, answered by the better of the two."""
    rows, signals = _signals(spark, d)
    percent, _ = A.confidence(signals, F.col("sources") == 0)
    first = stored(rows.select("query", percent.alias("percent")), "retry-confidence")
    items = _items(spark, d)
    names = items.select("item_id", F.col("answer").alias("name")).where("name IS NOT NULL")
    alike = A.match_bank(names.select("name").distinct(), items.select(F.col("item_id").alias("entry"), "text"))
    bank = names.join(alike, "name").select(F.col("item_id").alias("query"), "entry", "similarity").where("query <> entry").dropDuplicates(["query"])
    return A.retried(first, bank, first.select(F.col("query").alias("entry"), "percent")).withColumnRenamed("query", "item_id")


_FOLD = "lower(trim(canonical))"
_STOPS = ", ".join(f"'{w}'" for w in L.FUNCTION_WORDS)
_CONTENT = ", ".join(f"'{w}'" for w in L.CONTENT_STOP)
_CH = f"""t AS (SELECT chunk_id AS doc_id, {_TOK.format('text')} AS ts FROM (SELECT DISTINCT chunk_id, text FROM chunks)), s AS (SELECT count(*) AS n, avg(len(ts)) AS avgdl FROM t),
p AS (SELECT doc_id, len(ts) AS dl, unnest(ts) AS term FROM t), po AS (SELECT doc_id, dl, term, count(*) AS tf FROM p GROUP BY ALL), te AS (SELECT term, count(*) AS df, ln(1 + (any_value(n) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM po, s GROUP BY term),
qt AS (SELECT item_id, unnest({_TOK.format('text')}) AS term FROM benchmark_items), q AS (SELECT item_id, term, count(*)::DOUBLE AS w FROM qt GROUP BY ALL),
hit AS (SELECT * FROM (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM {_BM('q')}) WHERE rank <= 6),
ch AS (SELECT DISTINCT chunk_id, document_id, source_system FROM chunks), cited AS (SELECT item_id, rank, document_id FROM hit JOIN ch ON ch.chunk_id = hit.doc_id)"""
_LINK = f"ln AS (SELECT DISTINCT {_FOLD} AS entity, document_id FROM entity_mentions WHERE trim(canonical) <> '' AND document_id IS NOT NULL)"
_CROSS = f"cr AS (SELECT entity FROM (SELECT DISTINCT {_FOLD} AS entity, chunk_id FROM entity_mentions WHERE trim(canonical) <> '') JOIN (SELECT DISTINCT chunk_id, source_system FROM chunks WHERE source_system IS NOT NULL) USING (chunk_id) GROUP BY 1 HAVING count(DISTINCT source_system) > 1)"
_FOCUS = "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(lower(text), '\\b{t}\\b') THEN '{t}' END" for t in sorted(L.FOCUS_TERMS, key=lambda t: (-len(t), t))) + "], lambda x: x IS NOT NULL)"
_CANON = f"regexp_replace(lower(trim(regexp_replace(m.name, '\\s+', ' ', 'g'))), '^(?:{'|'.join(N.LEADING)}) ', '')"

QUERIES = {f.__name__: f for f in (
    chunk_entities, entity_documents, graph_purpose, graph_bridges, graph_weak_pairs, citation_lineage, estimated_domains, demo_chunk, extracted_entities, rrf_explained, rare_term_gate, cohered_hits, file_name_facts,
    recall_severity, suggested_questions, health_extraction_quality, health_dating_methods, evaluation_gold_cases, evaluation_uplift, evaluation_weak_cases, clean_sentences, composed_replies, question_retry)}
SQL = {
    "chunk_entities": f"SELECT chunk_id, string_agg(e, '|' ORDER BY e) AS entities FROM (SELECT DISTINCT chunk_id, {_FOLD} AS e FROM entity_mentions WHERE chunk_id IS NOT NULL AND trim(canonical) <> '') GROUP BY 1",
    "entity_documents": f"SELECT {_FOLD} AS canonical, document_id, count(DISTINCT chunk_id) AS chunks FROM entity_mentions WHERE trim(canonical) <> '' AND document_id IS NOT NULL GROUP BY ALL",
    "graph_purpose": f"WITH {_LINK}, {_CROSS}, n AS (SELECT entity, count(*) AS n FROM ln GROUP BY 1) SELECT count(*) AS entities, count(*) FILTER (n > 1) AS in_several_documents, count(*) FILTER (entity IN (SELECT entity FROM cr)) AS cross_source FROM n",
    "graph_bridges": f"""WITH {_CH}, {_LINK}, {_CROSS}, cd AS (SELECT DISTINCT item_id, document_id FROM cited), sz AS (SELECT item_id, count(*) AS docs FROM cd GROUP BY 1 HAVING count(*) > 1),
mt AS (SELECT item_id, entity, count(*) AS shared FROM cd JOIN ln USING (document_id) GROUP BY ALL HAVING count(*) > 1), re AS (SELECT entity, count(*) AS reach FROM ln GROUP BY 1), nd AS (SELECT count(DISTINCT document_id) AS nd FROM chunks),
fo AS (SELECT item_id, {_FOCUS} AS focus FROM benchmark_items), fk AS (SELECT item_id, list_filter(focus, lambda f: len(list_filter(focus, lambda o: length(o) > length(f) AND contains(o, f))) = 0) AS focus FROM fo),
ev AS (SELECT item_id, entity, shared, reach, len(list_filter(focus, lambda f: contains(entity, f) OR contains(f, entity))) > 0 AS on_topic, entity IN (SELECT entity FROM cr) AS cross_source, docs, nd FROM mt JOIN sz USING (item_id) JOIN re USING (entity) JOIN fk USING (item_id), nd),
w AS (SELECT item_id, entity, shared, reach, on_topic, cross_source, round(3 * on_topic::INT + 1.2::DOUBLE * cross_source::INT + 1.5::DOUBLE * (1 - least(1, reach / nd)) + least(1, shared / docs), 6) AS weight FROM ev)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY weight DESC, entity) AS place FROM w) WHERE place <= 4""",
    "citation_lineage": f"WITH {_CH} SELECT item_id, document_id, count(*) AS citations, min(rank) AS first FROM cited GROUP BY ALL",
    "estimated_domains": "SELECT greatest(count(DISTINCT document_id), count(DISTINCT section_path[1])) AS domains FROM chunks",
    "demo_chunk": f"SELECT coalesce(min(chunk_id) FILTER (coalesce(len(list_filter(section_path, lambda x: regexp_matches(x, '{L.BOILERPLATE_SECTION}'))) = 0 AND length(text) > 80 AND len(section_path) > 0, false)), min(chunk_id)) AS chunk_id FROM chunks",
    "extracted_entities": f"""WITH c AS (SELECT chunk_id, regexp_replace(text, '[\\x{{C0}}-\\x{{D6}}\\x{{D8}}-\\x{{F6}}\\x{{F8}}-\\x{{24F}}]', '_', 'g') AS text FROM (SELECT DISTINCT chunk_id, text FROM chunks)), f AS (SELECT chunk_id, list_concat(list_transform(regexp_extract_all(text, '\\b({N.CAPITALISED})\\b', 1), lambda n: {{'name': n, 'kind': 'proper_noun'}}), list_transform(regexp_extract_all(text, '\\b({N.CAPITALS})\\b', 1), lambda n: {{'name': n, 'kind': 'acronym'}})) AS l FROM c),
e AS (SELECT chunk_id, unnest(l) AS m, generate_subscripts(l, 1) - 1 AS pos FROM f), k AS (SELECT *, regexp_split_to_array(lower(m.name), '\\s+') AS w FROM e)
SELECT chunk_id, pos, regexp_replace(trim(m.name), '(?i)^(?:{'|'.join(N.LEADING)}) ', '') AS name, {_CANON} AS canonical, m.kind AS kind FROM k WHERE len(list_filter(w, lambda x: x NOT IN ({_STOPS}))) > 0 AND (m.kind = 'acronym' OR len(w) > 1 OR length(m.name) >= 3)""",
    "rrf_explained": f"""WITH {_IDX} {_FUSE} SELECT item_id, doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score, string_agg(r || ' #' || rank || ' (+' || printf('%.6f', 1.0::DOUBLE / (60 + rank)) || ')', ', ' ORDER BY r) AS explanation
FROM (SELECT item_id, doc_id, rank, 'bm25' AS r FROM a WHERE rank <= 40 UNION ALL SELECT item_id, doc_id, rank, 'coverage' FROM c WHERE rank <= 40) GROUP BY ALL""",
    "rare_term_gate": f"WITH {_IDX}, r AS (SELECT item_id, max((df < 0.35::DOUBLE * n)::INT) AS rare FROM q JOIN te USING (term), s WHERE term NOT IN ({_CONTENT}) GROUP BY 1) SELECT DISTINCT item_id, coalesce(rare, 0) = 1 AS rare FROM q LEFT JOIN r USING (item_id)",
    "file_name_facts": "SELECT document_name, CASE " + " ".join(f"WHEN contains(lower(document_name), '{a}') THEN '{b}'" for a, b in PRODUCTS) + """ ELSE 'Unclassified' END AS product, CASE WHEN contains(lower(document_name), '_review_') THEN 'Review Memorandum' WHEN regexp_matches(lower(document_name), '^k\\d{2}') THEN '510(k) Summary'
 WHEN contains(lower(document_name), 'quick_reference') OR contains(lower(document_name), 'reference_manual') THEN 'Quick Reference Guide' WHEN contains(lower(document_name), 'ifu') OR contains(lower(document_name), 'instruction') THEN 'Instructions For Use' ELSE 'Document' END AS doc_type,
 CASE WHEN starts_with(document_name, 'K') THEN regexp_replace(string_split(document_name, '_')[1], '\\.[A-Za-z0-9]+$', '') ELSE '' END AS k_number FROM (SELECT DISTINCT document_name FROM chunks WHERE document_name IS NOT NULL)""",
    "recall_severity": "SELECT DISTINCT recall_number, CASE WHEN contains(lower(coalesce(reason_for_recall, '')), 'software') THEN 'software' ELSE 'other' END AS severity FROM enforcement_reports",
    "suggested_questions": r"WITH t AS (SELECT trim(regexp_replace(regexp_replace(regexp_replace(document_name, '\.[A-Za-z0-9]{1,5}$', ''), '^\d+[_\- ]+', ''), '[_\-]+', ' ', 'g')) AS topic FROM chunks), k AS (SELECT lower(topic) AS k, min(topic) AS topic FROM t WHERE topic <> '' GROUP BY 1 ORDER BY 1 LIMIT 4) SELECT topic, 'What is ' || topic || '?' AS question FROM k",
    "health_extraction_quality": f"WITH lg AS ({line_grades('chunk_id', '(SELECT DISTINCT chunk_id, text FROM chunks)')}), q AS (SELECT k, sum(CASE WHEN kind = 'prose' THEN quality ELSE 0 END) / count(*) AS q FROM lg GROUP BY 1), m AS (SELECT coalesce(avg(q), 0) AS q FROM q) SELECT round(q, 6) AS raw, round(100 * q, 2) AS score, (SELECT round(100 * avg((kind = 'prose')::INT), 2) FROM lg) AS prose_percent FROM m",
    "health_dating_methods": f"SELECT method, count(*) AS documents FROM ({STRUCTURE_SQL['document_dates']}) GROUP BY 1",
    "evaluation_gold_cases": _EV + """, g10 AS (SELECT * FROM a WHERE rank <= 10), mh AS (SELECT g10.item_id, rank, 0 AS matcher FROM g10 JOIN documents USING (doc_id) JOIN device_reference ON ref_id = g10.item_id WHERE lower(product) = lower(canonical_name)
UNION SELECT g10.item_id, rank, 1 FROM g10 JOIN documents USING (doc_id) JOIN device_reference ON ref_id = g10.item_id WHERE contains(lower(text), lower(string_split(canonical_name, ' ')[2]))),
mm AS (SELECT item_id, count(DISTINCT matcher) AS met, min(rank) AS first, list_sort(list(DISTINCT rank)) AS ranks FROM mh GROUP BY 1), sh AS (SELECT item_id, count(*) AS hits FROM g10 GROUP BY 1),
z AS (SELECT ref_id, CASE WHEN family = 'Strip' THEN 'all' ELSE 'any' END AS kind, coalesce(met, 0) AS met, first, ranks, coalesce(hits, 0) AS hits FROM device_reference LEFT JOIN mm ON mm.item_id = ref_id LEFT JOIN sh ON sh.item_id = ref_id),
y AS (SELECT *, CASE WHEN first IS NULL THEN 0 ELSE list_sum(list_transform(ranks, lambda r: 1 / log2(r + 1))) / list_sum(list_transform(generate_series(1, len(ranks)), lambda r: 1 / log2(r + 1))) END AS nd FROM z)
SELECT ref_id, kind, round(CASE WHEN kind = 'all' THEN met / 2 ELSE (coalesce(first, 99) <= 5)::INT END, 6)::DOUBLE AS recall_5, round(CASE WHEN kind = 'all' THEN met / 2 ELSE (first IS NOT NULL)::INT END, 6)::DOUBLE AS recall_10, round(CASE WHEN kind = 'all' THEN (met >= 2)::INT ELSE coalesce(1 / first, 0) END, 6)::DOUBLE AS mrr,
 round(CASE WHEN kind = 'all' THEN met / 2 ELSE nd END, 6)::DOUBLE AS ndcg_10, hits, CASE WHEN kind = 'all' THEN met >= 2 END AS cross_source_satisfied, NULL::BOOLEAN AS robustness FROM y""",
    "evaluation_uplift": _EV + f", e AS (SELECT mode, {_MEAN} FROM cm GROUP BY 1), u AS (SELECT max(recall_10) FILTER (mode = 'hybrid') AS h, max(recall_10) FILTER (mode = 'lexical') AS l FROM e) SELECT 'recall_10' AS metric, round(h - l, 6) AS delta, round(coalesce(100 * (h - l) / nullif(l, 0), 0), 4) AS percent FROM u",
    "evaluation_weak_cases": _EV + " SELECT item_id AS ref_id, recall_10 FROM cm WHERE mode = 'hybrid' AND recall_10 < 1",
}
