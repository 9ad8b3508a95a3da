"""Structure, ingest and text-quality queries with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions import lexicons as L
from factloom.functions.sentences import chunk_quality, classified, repaired_text, sentences
from factloom.functions.text import classify_sentence, sanitize
from factloom.operators.fusion import facet_counts
from factloom.operators.lexical import vocabulary
from factloom.operators.structure import dated, document_lines, document_meta, first_seen_ids, head_text, pack_paragraphs, sections
from factloom.session import table
from factloom.sources import verbalise as V


def heading_detection(spark, d):
    return document_lines(table(spark, d, "documents"), "doc_id").where("heading").select(F.col("doc").alias("doc_id"), "line_no", "line")


def line_sections(spark, d):
    s = sections(document_lines(table(spark, d, "documents"), "doc_id"))
    return s.select(F.col("doc").alias("doc_id"), "line_no", F.array_join("section_path", " > ").alias("section"))


def _paragraphs(spark, d) -> DataFrame:
    return table(spark, d, "paragraphs").dropDuplicates(["paragraph_id"])


def chunk_packing(spark, d):
    p = pack_paragraphs(_paragraphs(spark, d), "document_id", "paragraph_index", ["document_name", "section_path", "page"])
    return p.select("document_id", F.col("first").alias("first_index"), "n", "chars")


def chunk_packing_overlap(spark, d):
    p = pack_paragraphs(_paragraphs(spark, d), "document_id", "paragraph_index", ["section_path", "page"], overlap=True)
    return p.select("document_id", F.col("first").alias("first_index"), F.col("last").alias("last_index"), "n", "chars")


def first_seen_sources(spark, d):
    return first_seen_ids(table(spark, d, "documents"), "source", "doc_id")


def line_kinds(spark, d):
    """Kind and quality of every chunk line, each line taken as one sentence of attested words."""
    lines = document_lines(table(spark, d, "chunks").dropDuplicates(["chunk_id"]), "chunk_id")
    return lines.withColumn("graded", classify_sentence("line", 3)).select(F.col("doc").alias("chunk_id"), "line_no", "graded.kind", "graded.quality")


def _graded(spark, d):
    chunks = table(spark, d, "chunks").dropDuplicates(["chunk_id"])
    return classified(sentences(chunks, "chunk_id"), vocabulary(chunks))


def sentence_kinds(spark, d):
    return _graded(spark, d).groupBy("kind").agg(F.count("*").alias("n"), F.round(F.avg("quality"), 6).alias("quality"))


def chunk_quality_scores(spark, d):
    return chunk_quality(_graded(spark, d), "chunk_id")


def text_repair(spark, d):
    p = _paragraphs(spark, d)
    return repaired_text(p, "paragraph_id", vocabulary(p))


def sanitize_fields(spark, d):
    cols = ["device_name", "applicant", "city", "state", "product_code"]
    return table(spark, d, "clearances_510k").select("k_number", *[sanitize(c).alias(c) for c in cols])


def _records(spark, d):
    t = lambda name: table(spark, d, name)
    return V.union_in_order([V.clearances(t("clearances_510k")), V.classifications(t("product_code_classifications")), V.recalls(t("enforcement_reports")), V.documents_index(t("nova_ifu_document_index"))])


def verbalised_records(spark, d):
    return _records(spark, d).select("source_ord", "source_id", "record_type", "title", "text", "year")


def record_facets(spark, d):
    return facet_counts(_records(spark, d), ["record_type", "year", "source_type"])


def keep_first_device(spark, d):
    c = table(spark, d, "clearances_510k").select(F.lower(sanitize("applicant")).alias("applicant"), F.lower(sanitize("device_name")).alias("device"), "k_number", "loaded_at")
    return V.keep_first(c, ["applicant", "device"], ["loaded_at", "k_number"]).select("applicant", "device", "k_number")


def document_metadata(spark, d):
    return document_meta(table(spark, d, "chunks"), "document_id", "chunk_id", ["document_name", "page", "source_system"])


def document_heads(spark, d):
    c = table(spark, d, "chunks").dropDuplicates(["chunk_id"])
    return head_text(c, "document_id", "chunk_id").select("document_id", F.length("head").alias("n_chars"), F.md5("head").alias("digest"))


def document_dates(spark, d):
    x = table(spark, d, "documents").select("doc_id", dated(F.lit(None).cast("string"), F.col("text")).alias("x"))
    return x.select("doc_id", "x.date", "x.method", "x.confidence")


def clearance_dates(spark, d):
    x = table(spark, d, "clearances_510k").select("k_number", "decision_date", dated(sanitize("decision_date"), F.lit("")).alias("x"))
    return x.select("k_number", "decision_date", "x.date", "x.method").distinct()


_LINES = """l AS (SELECT {k} AS k, generate_subscripts(string_split(text, chr(10)), 1) AS line_no, regexp_replace(unnest(string_split(text, chr(10))), '^\\s+|\\s+$', '', 'g') AS line FROM {t}),
h AS (SELECT k, line_no, line, list_filter(regexp_split_to_array(line, '\\s+'), lambda w: w <> '') AS w FROM l WHERE line <> ''),
g AS (SELECT *, length(line) <= 80 AND NOT regexp_matches(line, '[.,;:?!]$') AND ((upper(line) = line AND regexp_matches(line, '[A-Z]') AND length(line) > 3)
  OR (regexp_matches(line, '^[A-Z][A-Za-z0-9 &/\\-]{{2,80}}$') AND len(list_filter(w, lambda x: regexp_matches(x, '^[A-Z]'))) >= 0.6::DOUBLE * len(w))) AS heading FROM h)"""
_DOC_LINES = _LINES.format(k="doc_id", t="documents")
_SAN = lambda c: f"coalesce(CASE WHEN lower(trim(regexp_replace({c}, '\\s+', ' ', 'g'))) IN ('nan', 'none', 'null', 'n/a') THEN '' ELSE trim(regexp_replace({c}, '\\s+', ' ', 'g')) END, '')"
_DEF = lambda c, v: f"CASE WHEN {_SAN(c)} = '' THEN '{v}' ELSE {_SAN(c)} END"
_REC = f"""r AS (
SELECT 0 AS source_ord, {_SAN('k_number')} AS source_id, 'clearance' AS record_type, {_SAN('k_number')} || ' - ' || {_DEF('device_name', 'an unnamed device')} AS title,
  {_DEF('applicant', 'An applicant')} || ' notified ' || {_DEF('device_name', 'an unnamed device')} || ' as ' || {_SAN('k_number')} || '; the decision was ' || lower({_DEF('decision_description', 'not stated')}) || ' under code ' || {_DEF('product_code', 'not stated')} || '.' AS text, left({_SAN('decision_date')}, 4) AS year FROM clearances_510k
UNION ALL SELECT 1, CASE WHEN {_SAN('product_code')} <> '' THEN 'CODE-' || {_SAN('product_code')} ELSE '' END, 'classification', 'Code ' || {_SAN('product_code')} || ' - ' || {_DEF('device_name', 'an unnamed device type')},
  'Code ' || {_SAN('product_code')} || ' covers ' || {_DEF('device_name', 'an unnamed device type')} || ', class ' || {_DEF('device_class', 'not stated')} || ', regulation ' || {_DEF('regulation_number', 'not stated')} || '.', '' FROM product_code_classifications
UNION ALL SELECT 2, CASE WHEN {_SAN('recall_number')} <> '' THEN {_SAN('recall_number')} ELSE 'RECALL-' || {_SAN('recall_initiation_date')} END, 'recall', 'Recall ' || CASE WHEN {_SAN('recall_number')} <> '' THEN {_SAN('recall_number')} ELSE 'RECALL-' || {_SAN('recall_initiation_date')} END || ' - ' || left({_SAN('product_description')}, 60),
  'Recall of ' || {_DEF('product_description', 'an unnamed product')} || ' because: ' || {_DEF('reason_for_recall', 'not stated')} || ' Status: ' || {_DEF('status', 'not stated')} || '.', left({_SAN('recall_initiation_date')}, 4) FROM enforcement_reports
UNION ALL SELECT 3, CASE WHEN {_SAN('ifu_id')} <> '' THEN {_SAN('ifu_id')} WHEN {_SAN('literature_part_number')} <> '' THEN 'IFU-' || {_SAN('literature_part_number')} ELSE 'IFU-' || left({_SAN('title')}, 30) END, 'ifu_catalogue', {_SAN('title')}, 'The catalogue lists ' || {_SAN('title')} || ' for ' || {_DEF('product', 'an unnamed product')} || ' as ' || {_DEF('doc_type', 'a document')} || '.' || CASE WHEN {_SAN('url')} <> '' THEN ' It is published at ' || {_SAN('url')} || '.' ELSE '' END, '' FROM nova_ifu_document_index WHERE {_SAN('title')} <> '')"""
_ISO = lambda y, m, dd: f"CASE WHEN try_cast({y} AS INT) BETWEEN 2000 AND 2027 THEN strftime(make_date(try_cast({y} AS INT), greatest(1, least(12, coalesce(try_cast({m} AS INT), 1))), greatest(1, least(28, coalesce(try_cast({dd} AS INT), 1)))), '%Y-%m-%d') END"
_X = lambda p, i: f"nullif(regexp_extract(left(text, 4000), '{p}', {i}), '')"
_R, _I, _M = (p.replace("(?i)", "(?i)") for p in (
    r"(?i)\b(?:rev(?:ision)?|revised|effective|issued)\b[^.\n]{0,24}?(20[0-2][0-9])[-/]([0-9]{1,2})(?:[-/]([0-9]{1,2}))?", r"\b(20[0-2][0-9])-([0-9]{2})-([0-9]{2})\b",
    r"(?i)\b(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.?\s+(20[0-2][0-9])\b"))
_MONTHNO = f"CAST(list_position(['jan','feb','mar','apr','may','jun','jul','aug','sep','oct','nov','dec'], lower({_X(_M, 1)})) AS VARCHAR)"



def line_grades(k: str, t: str) -> str:
    """SQL of (k, line_no, kind, quality) of the lines of a table's text."""
    return f"""WITH {_LINES.format(k=k, t=t)}, c AS (SELECT k, line_no, line, length(line) AS n, len(w) AS c, len(regexp_extract_all(line, '\\p{{L}}')) / length(line) AS al, len(regexp_extract_all(line, '\\p{{Nd}}')) / length(line) AS di,
  len(list_filter(w, lambda x: regexp_matches(x, '^[0-9.,%()+\\-]+$'))) AS nu, len(list_filter(w, lambda x: length(x) <= 3)) AS sh, len(list_filter(w, lambda x: regexp_matches(x, '^\\p{{Lu}}'))) AS ca, regexp_matches(line, '[.!?]$') AS e FROM h)
SELECT k, line_no, CASE WHEN n < 25 THEN 'fragment' WHEN regexp_matches(line, '{L.CONTENTS}') THEN 'header' WHEN regexp_matches(line, '{L.LEGAL}') THEN 'legal' WHEN regexp_matches(line, '{L.EQUATION}') OR al < 0.45::DOUBLE THEN 'equation'
  WHEN di > 0.18::DOUBLE OR (c > 8 AND nu > 0.30::DOUBLE * c) OR (c > 10 AND sh > 0.72::DOUBLE * c AND nu > 0) THEN 'table' WHEN NOT e AND c <= 9 AND ca > 0.6::DOUBLE * c THEN 'header' ELSE 'prose' END AS kind,
 round(CASE WHEN n < 25 THEN 0.0::DOUBLE WHEN regexp_matches(line, '{L.CONTENTS}') THEN 0.0 WHEN regexp_matches(line, '{L.LEGAL}') THEN 0.05 WHEN regexp_matches(line, '{L.EQUATION}') OR al < 0.45::DOUBLE THEN 0.05
  WHEN di > 0.18::DOUBLE OR (c > 8 AND nu > 0.30::DOUBLE * c) OR (c > 10 AND sh > 0.72::DOUBLE * c AND nu > 0) THEN 0.1 WHEN NOT e AND c <= 9 AND ca > 0.6::DOUBLE * c THEN 0.15
  ELSE least(1.0::DOUBLE, greatest(0.0::DOUBLE, 0.55::DOUBLE + CASE WHEN e THEN 0.15 ELSE 0 END + CASE WHEN c BETWEEN 12 AND 45 THEN 0.15 WHEN c > 70 THEN -0.15 ELSE 0 END + CASE WHEN regexp_matches(line, '{L.STATEMENT}') THEN 0.15 ELSE 0 END
   + CASE WHEN regexp_matches(line, '^\\p{{Lu}}') THEN 0.05 ELSE 0 END - CASE WHEN di > 0.10::DOUBLE THEN 0.10 ELSE 0 END)) END, 3) AS quality FROM c"""


QUERIES = {f.__name__: f for f in (
    heading_detection, line_sections, chunk_packing, chunk_packing_overlap, first_seen_sources, line_kinds, sentence_kinds, chunk_quality_scores, text_repair, sanitize_fields,
    verbalised_records, record_facets, keep_first_device, document_metadata, document_heads, document_dates, clearance_dates)}
SQL = {
    "heading_detection": f"WITH {_DOC_LINES} SELECT k AS doc_id, line_no, line FROM g WHERE heading",
    "line_sections": f"""WITH {_DOC_LINES}, s AS (SELECT *, heading AND upper(line) = line AS shout FROM g),
w AS (SELECT *, last_value(CASE WHEN shout THEN line_no END IGNORE NULLS) OVER a AS on_, last_value(CASE WHEN shout THEN line END IGNORE NULLS) OVER a AS ol,
  last_value(CASE WHEN heading AND NOT shout THEN line_no END IGNORE NULLS) OVER a AS in_, last_value(CASE WHEN heading AND NOT shout THEN line END IGNORE NULLS) OVER a AS il FROM s WINDOW a AS (PARTITION BY k ORDER BY line_no ROWS UNBOUNDED PRECEDING))
SELECT k AS doc_id, line_no, coalesce(concat_ws(' > ', ol, CASE WHEN on_ IS NULL OR in_ > on_ THEN il END), '') AS section FROM w WHERE NOT heading""",
    "chunk_packing": """WITH RECURSIVE p AS (SELECT DISTINCT paragraph_id, document_id, document_name, section_path, page, paragraph_index AS i, coalesce(length(text), 0) AS n FROM paragraphs),
m AS (SELECT *, CASE WHEN lag(i) OVER a IS NULL OR lag(document_name) OVER a IS DISTINCT FROM document_name OR lag(section_path) OVER a IS DISTINCT FROM section_path OR lag(page) OVER a IS DISTINCT FROM page THEN 1 ELSE 0 END AS new FROM p WINDOW a AS (PARTITION BY document_id ORDER BY i)),
s AS (SELECT *, sum(new) OVER (PARTITION BY document_id ORDER BY i) AS island FROM m), o AS (SELECT *, row_number() OVER (PARTITION BY document_id, island ORDER BY i) AS r FROM s),
f AS (SELECT document_id, island, r, i, n, 1 AS g, n AS acc FROM o WHERE r = 1 UNION ALL SELECT o.document_id, o.island, o.r, o.i, o.n, CASE WHEN f.acc >= 700 THEN f.g + 1 ELSE f.g END, CASE WHEN f.acc >= 700 THEN o.n ELSE f.acc + o.n END
  FROM f JOIN o ON o.document_id = f.document_id AND o.island = f.island AND o.r = f.r + 1)
SELECT document_id, min(i) AS first_index, count(*) AS n, sum(n)::BIGINT AS chars FROM f GROUP BY document_id, island, g""",
    "first_seen_sources": "SELECT source, row_number() OVER (ORDER BY f, source) - 1 AS id FROM (SELECT source, min(doc_id) AS f FROM documents WHERE source IS NOT NULL GROUP BY 1)",
    "line_kinds": f"SELECT k AS chunk_id, line_no, kind, quality FROM ({line_grades('chunk_id', '(SELECT DISTINCT chunk_id, text FROM chunks)')})",
    "sanitize_fields": "SELECT k_number, " + ", ".join(f"{_SAN(c)} AS {c}" for c in ("device_name", "applicant", "city", "state", "product_code")) + " FROM clearances_510k",
    "verbalised_records": f"WITH {_REC} SELECT source_ord, source_id, record_type, title, text, year FROM r WHERE source_id <> ''",
    "record_facets": f"WITH {_REC}, f AS (SELECT 'record_type' AS dimension, record_type AS value FROM r WHERE source_id <> '' UNION ALL SELECT 'year', year FROM r WHERE source_id <> '' UNION ALL SELECT 'source_type', 'registry' FROM r WHERE source_id <> '') SELECT dimension, value, n FROM (SELECT *, row_number() OVER (PARTITION BY dimension ORDER BY n DESC, value) AS k FROM (SELECT dimension, value, count(*) AS n FROM f WHERE value <> '' GROUP BY ALL)) WHERE k <= 60",
    "keep_first_device": f"SELECT applicant, device, k_number FROM (SELECT *, row_number() OVER (PARTITION BY applicant, device ORDER BY loaded_at NULLS FIRST, k_number) AS r FROM (SELECT lower({_SAN('applicant')}) AS applicant, lower({_SAN('device_name')}) AS device, k_number, loaded_at FROM clearances_510k)) WHERE r = 1",
    "document_metadata": "SELECT document_id, arg_min(document_name, chunk_id) AS document_name, arg_min(page, chunk_id) AS page, arg_min(source_system, chunk_id) AS source_system, count(DISTINCT chunk_id) AS chunk_count FROM chunks GROUP BY 1",
    "document_heads": "WITH c AS (SELECT DISTINCT chunk_id, document_id, text FROM chunks), b AS (SELECT *, coalesce(sum(length(text)) OVER (PARTITION BY document_id ORDER BY chunk_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM c), h AS (SELECT document_id, string_agg(text, chr(10) ORDER BY chunk_id) AS head FROM b WHERE before < 4000 GROUP BY 1) SELECT document_id, length(head) AS n_chars, md5(head) AS digest FROM h",
    "document_dates": f"WITH x AS (SELECT doc_id, {_ISO(_X(_R, 1), _X(_R, 2), _X(_R, 3))} AS a, coalesce({_ISO(_X(_I, 1), _X(_I, 2), _X(_I, 3))}, {_ISO(_X(_M, 2), _MONTHNO, 1)}) AS b FROM documents) SELECT doc_id, coalesce(a, b) AS date, CASE WHEN a IS NOT NULL THEN 'document_control' WHEN b IS NOT NULL THEN 'text_date' ELSE 'unknown' END AS method, CASE WHEN a IS NOT NULL THEN 0.85::DOUBLE WHEN b IS NOT NULL THEN 0.35 ELSE 0 END AS confidence FROM x",
    "clearance_dates": f"WITH s AS (SELECT k_number, decision_date, {_SAN('decision_date')} AS v FROM clearances_510k), x AS (SELECT *, CASE WHEN regexp_matches(v, '^20[0-2][0-9]-[0-9]{{2}}-[0-9]{{2}}$') THEN v WHEN contains(v, '-') THEN {_ISO(*(f'string_split(v, chr(45))[{i}]' for i in (1, 2, 3)))} END AS date FROM s) SELECT DISTINCT k_number, decision_date, date, CASE WHEN date IS NULL THEN 'unknown' ELSE 'regulatory' END AS method FROM x",
}
