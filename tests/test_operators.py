"""Index, fusion, vectors, packing, graph, answers, evaluation, health, semantic index and sources."""

import io
import random
import zipfile

import numpy as np
from pyspark.sql import functions as F

from factloom.operators import answers as A
from factloom.operators import graph as G
from factloom.operators.evaluation import case_metrics, gate, mean_metrics
from factloom.operators.fusion import facet_counts, faceted, reciprocal_rank_fusion
from factloom.operators.health import health_metrics, health_overall, timeline
from factloom.operators.lexical import bm25, build_index, expanded_terms, query_terms, top_k
from factloom.operators.semantic import build_semantic, quantize, semantic_search
from factloom.operators.structure import document_lines, pack_paragraphs, sections
from factloom.operators.vectors import cosine_top_k
from factloom.sources.connectors import CsvConnector, DocumentConnector, registry
from factloom.sources.parse import docx_paragraphs, html_paragraphs, markdown_paragraphs, read_paragraphs, text_paragraphs
from factloom.streaming.ingest import follow, merged


def test_bm25_ranks_and_empty_corpus(spark):
    docs = spark.createDataFrame([(1, "glucose meter battery"), (2, "lactate strip storage"), (3, "glucose glucose control"), (4, None), (1, "glucose meter battery")], "id int, text string")
    asked = query_terms(spark.createDataFrame([(1, "glucose glucose battery"), (2, "zzz"), (3, None)], "q int, text string"), "q", "text")
    got = top_k(bm25(build_index(docs, "id"), asked), 5).collect()
    assert [(r.query, r.doc) for r in got] == [(1, 1), (1, 3)] and got[0].score > got[1].score > 0
    assert bm25(build_index(docs.where("id > 9"), "id"), asked).count() == 0


def test_expansion_only_adds_indexed_terms(spark):
    terms = spark.createDataFrame([("strip",), ("strips",), ("stripping",), ("stripes",)], "term string")
    synonyms = spark.createDataFrame([("cartridge", "strip"), ("cartridge", "absent")], "term string, variant string")
    got = {(r.term, r.weight) for r in expanded_terms(spark.createDataFrame([(1, "strip cartridge")], "q int, text string"), "q", "text", terms, synonyms).collect()}
    assert ("strip", 1.0) in got and ("strips", 0.55) in got and ("stripping", 0.55) in got and not any(t == "absent" for t, _ in got)


def test_fusion_is_a_full_outer_merge(spark):
    runs = spark.createDataFrame([(1, "a", 10, 1, 1.0), (1, "a", 11, 2, 1.0), (1, "b", 11, 1, 1.0), (1, "b", 12, 41, 1.0)], "query int, retriever string, doc int, rank int, weight double")
    got = {r.doc: (round(r.score, 6), r.retrievers) for r in reciprocal_rank_fusion(runs).collect()}
    assert got == {10: (round(1 / 61, 6), "a"), 11: (round(1 / 62 + 1 / 61, 6), "a+b")}
    docs = spark.createDataFrame([(10, "en", None), (11, "de", "x")], "id int, lang string, kind string")
    ranked = spark.createDataFrame([(1, 10), (1, 11)], "query int, doc int")
    assert [r.doc for r in faceted(ranked, docs, "id", {"kind": "x", "lang": "all"}).collect()] == [11]
    assert {tuple(r) for r in facet_counts(docs, ["lang", "kind"]).collect()} == {("lang", "en", 1), ("lang", "de", 1), ("kind", "x", 1)}


def test_cosine_against_brute_force(spark):
    rng = np.random.default_rng(1)
    m = rng.normal(size=(60, 8))
    m[5] = m[6]
    rows = [(i, v.tolist()) for i, v in enumerate(m)] + [(100, [0.0] * 8), (101, None)]
    v = spark.createDataFrame(rows, "id bigint, v array<double>")
    got = {(r.query, r["rank"]): r.doc for r in cosine_top_k(v, v.where("id % 20 = 0"), "id", "v", 5).collect()}
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    for q in (0, 20, 40):
        s = np.round(u @ u[q], 6)
        want = sorted((i for i in range(60) if i != q), key=lambda i: (-s[i], i))[:5]
        assert [got[q, r] for r in range(1, 6)] == want


def test_packing_against_a_loop(spark):
    rnd = random.Random(3)
    rows = [(d, i, rnd.choice("ab"), "x" * rnd.choice([0, 90, 300, 800])) for d in range(6) for i in range(25)]
    df = spark.createDataFrame(rows, "doc int, i int, sec string, text string")
    for overlap in (False, True):
        want = []
        for d in range(6):
            held, key = [], None
            for _, i, sec, t in [r for r in rows if r[0] == d]:
                if key not in (None, sec) and held:
                    want.append((d, held[0][0], len(held)))
                    held = []
                key = sec
                held.append((i, len(t)))
                if sum(n for _, n in held) >= 700:
                    want.append((d, held[0][0], len(held)))
                    held = held[-1:] if overlap and len(held) > 1 else []
            if held:
                want.append((d, held[0][0], len(held)))
        got = [(r.doc, r.first, r.n) for r in pack_paragraphs(df, "doc", "i", ["sec"], overlap=overlap).collect()]
        assert sorted(got) == sorted(want)


def test_sections_nest_titles_under_capitals(spark):
    text = "QUALITY CONTROL\nDaily Checks\nRun the control first.\nWeekly Checks\nthen the other\nSTORAGE\nkeep it dry"
    got = [(r.line, r.section_path) for r in sections(document_lines(spark.createDataFrame([(1, text)], "d int, text string"), "d")).orderBy("line_no").collect()]
    assert got == [("Run the control first.", ["QUALITY CONTROL", "Daily Checks"]), ("then the other", ["QUALITY CONTROL", "Weekly Checks"]), ("keep it dry", ["STORAGE"])]


def records(spark):
    e = "array<struct<kind:string,name:string>>"
    rows = [("R1", "registry", "K123456 measures glucose and sodium.", "t", {"record_type": "clearance", "k_number": "K123456", "product_code": "ABC"}, [("Product", "Zorvath"), (None, "x")]),
            ("D1", "document", "Glucose is measured. See K123456.", "Guide", {"record_type": "document_paragraph", "document_name": "guide.pdf"}, [("Product", "zorvath ")]),
            ("C1", "registry", "Code", "t", {"record_type": "classification", "product_code": "abc"}, [("Regulation", "862.1")]), ("N1", "registry", None, None, None, None)]
    return spark.createDataFrame(rows, f"source_id string, source_type string, text string, title string, metadata map<string,string>, entities {e}")


def test_graph_links_sources(spark):
    events = G.graph_events(records(spark))
    edges = G.graph_edges(events)
    kinds = {r.type for r in edges.collect()}
    assert kinds == {"GOVERNED_BY", "CLEARED_UNDER", "CLASSIFIED_UNDER", "DOCUMENTED_IN", "MEASURES"}
    nodes = {r.key: r for r in G.graph_nodes(events, edges).collect()}
    assert nodes["Product:zorvath"].cross_source and nodes["Clearance:k123456"].mentions == 3
    ends = {r.a for r in edges.collect()} | {r.b for r in edges.collect()}
    assert ends <= set(nodes)
    assert [tuple(r) for r in G.reachable_regulations(edges).collect()] == [("Product:zorvath", "Regulation:862.1", 1)]
    hop = G.trace_one_hop(edges, spark.createDataFrame([("Product:zorvath",)], "key string")).collect()
    assert all("Product:zorvath" in (r.a, r.b) and r.neighbour != "Product:zorvath" for r in hop) and len(hop) == 4
    assert {r["metric"]: r.value for r in G.graph_stats(events, edges).collect()}["cross_source_products"] == 1


def test_cooccurrence_and_isolation(spark):
    rows = [(1, "A", 1, 1), (2, "b", 1, 1), (3, "a ", 2, 1), (4, "B", 2, 1), (5, "c", 2, 2), (6, None, 2, 2), (7, "d", 3, 3)]
    m = spark.createDataFrame(rows, "mention_id int, canonical string, chunk_id int, document_id int")
    assert [tuple(r) for r in G.cooccurring(m, "chunk_id", "canonical").collect()] == [("a", "b", 2)]
    assert {r.document_id for r in G.isolated_documents(m).collect()} == {1, 2, 3}


def test_questions(spark):
    qs = [("What is the intended use of the lactate meter?", "INTENDED_USE"), ("Which substances interfere?", "INTERFERENCE"), ("Hello there", "GENERAL"), ("", "GENERAL"), (None, "GENERAL")]
    assert all(r.i == r.want for r in spark.createDataFrame(qs, "q string, want string").select("want", A.intent_of("q").alias("i")).collect())
    assert spark.createDataFrame([(qs[0][0],)], "q string").select(A.focus_of("q")).first()[0] == ["lactate", "meter"]


def test_diverse_selection(spark):
    rows = [(1, i, 0, s, s.lower().split(), f) for i, (s, f) in enumerate([("alpha beta gamma delta", 0.9), ("alpha beta gamma delta", 0.8), ("one two three four", 0.5), ("x " * 500, 0.4)])]
    got = A.select_diverse(spark.createDataFrame(rows, "query int, doc int, pos int, sentence string, own array<string>, final double")).orderBy("pick").collect()
    assert [r.doc for r in got] == [0, 2]
    reply = A.composed(spark.createDataFrame(got)).first()
    assert reply.answer == "Alpha beta gamma delta. [1] One two three four. [2]" and reply.citations == 2


def test_confidence_bounds(spark):
    s = {k: F.lit(1.0) for k in ("margin", "agreement", "coverage", "consensus", "quality")}
    p, b = A.confidence(s, F.lit(False))
    z, zb = A.confidence({k: F.lit(0.0) for k in s}, F.lit(False))
    e, _ = A.confidence(s, F.lit(True))
    assert spark.range(1).select(p, b, z, zb, e).first()[:] == (100.0, "high", 2.0, "insufficient", 0.0)


def test_typeahead(spark):
    names = spark.createDataFrame([(1, "Glucose Meter"), (2, "Pro Glucose Meter"), (3, "Meter of Glucose"), (4, None)], "id int, name string")
    got = [(r.id, r["rank"]) for r in A.suggest(spark.createDataFrame([("glucose meter",), ("",), ("zz",)], "probe string"), names).orderBy("rank").collect()]
    assert got == [(1, 1), (2, 2), (3, 3)]
    assert A.subsequence_score("glm", "glucose meter") > 0 and A.subsequence_score("mg", "gm") == 0
    assert [r.id for r in A.fuzzy_suggest(["glcs mtr"], names).collect()]


def test_bank_match(spark):
    bank = spark.createDataFrame([(1, "sodium electrode drift"), (2, "glucose strip storage")], "entry int, text string")
    got = A.match_bank(spark.createDataFrame([("storage of glucose strip",), ("the",), (None,)], "name string"), bank).collect()
    assert [(r.entry, r.similarity) for r in got] == [(2, 1.0)]


def test_evaluation(spark):
    ranked = spark.createDataFrame([("m", 1, 10, 1), ("m", 1, 11, 2), ("m", 2, 20, 7)], "mode string, query int, doc int, rank int")
    gold = spark.createDataFrame([(1, 11), (2, 20), (3, 30)], "query int, doc int")
    means = mean_metrics(case_metrics(ranked, gold), ["mode"])
    r = means.first()
    assert (r.recall_5, r.recall_10, r.cases) == (0.333333, 0.666667, 3) and abs(r.mrr - (0.5 + 1 / 7) / 3) < 1e-5
    assert [x.passed for x in gate(means, "m").collect()] == [False, False]


def test_health(spark):
    chunks = spark.createDataFrame([(i, i // 4) for i in range(40)], "chunk_id int, document_id int")
    mentions = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), (None, 3)], "canonical string, document_id int")
    docs = spark.sql("SELECT * FROM VALUES (TIMESTAMP '2025-01-01'), (TIMESTAMP '2020-01-01'), (TIMESTAMP '2015-01-01'), (NULL) AS t(published_at)")
    m = {r["metric"]: r for r in health_metrics(chunks, mentions, docs, "2026-01-01").collect()}
    assert m["coverage"].raw == 4.0 and m["connectivity"].score == 100.0 and m["provenance"].raw == 0.75 and m["freshness"].raw == 2192
    assert health_overall(spark.createDataFrame(list(m.values()))).first().weakest == "freshness"
    assert [r.documents for r in timeline(chunks).orderBy("bucket").collect()] == [2] * 5
    assert all(r.score == 0 for r in health_metrics(chunks.where("false"), mentions.where("false"), docs.where("false"), "2026-01-01").where("metric <> 'freshness'").collect())


def test_semantic_index_finds_the_cluster(spark):
    texts = ["renal creatinine kidney function", "creatinine kidney clearance renal", "kidney renal creatinine estimate", "quality control level limits", "control limits quality lot", "quality lot control material", "glucose strip sugar", "sugar glucose reading"]
    index = build_semantic(spark.createDataFrame(list(enumerate(texts)), "id int, text string"), "id", dims=4)
    assert index.enabled and index.embed("unknownword") is None
    top = semantic_search(index, [(1, "renal kidney"), (2, "unknownword")], 3).collect()
    assert {r.doc for r in top} == {0, 1, 2} and {r["query"] for r in top} == {1}
    assert not build_semantic(spark.createDataFrame([(1, "a b")], "id int, text string"), "id").enabled
    q, scale = quantize(np.array([[0.5, -1.0], [0.0, 0.25]]))
    assert q.dtype == np.int8 and np.allclose(q * scale, [[0.5, -1.0], [0.0, 0.25]], atol=scale)


def test_registered_semantic_run_equals_a_dense_svd(spark, tmp_path):
    from factloom.plans.answers import QUERIES

    rnd = random.Random(3)
    words = [f"w{i}x" for i in range(90)]
    texts = [" ".join(rnd.choices(words, k=30)) for _ in range(60)]
    asked = [(q, " ".join(rnd.choices(words, k=4))) for q in range(5)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(asked, "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark_items.parquet")
    tf = np.array([[t.split().count(w) for w in words] for t in texts], dtype=float)
    df = (tf > 0).sum(axis=0)
    assert df.min() >= 2
    idf = np.log(61 / (1 + df)) + 1
    a = np.where(tf > 0, 1 + np.log(np.maximum(tf, 1)), 0) * idf
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    _, singular, vt = np.linalg.svd(a, full_matrices=False)
    unit = lambda m: m / np.linalg.norm(m, axis=-1, keepdims=True)
    docs, terms = unit(a @ vt[:59].T), unit(vt[:59].T * singular[:59])  # 59 = min(96, terms - 1, docs - 1)
    got = QUERIES["semantic_search"](spark, str(tmp_path)).collect()
    assert len(got) == 50
    for q, t in asked:
        at = [words.index(w) for w in t.split()]
        score = docs @ unit((idf[at, None] * terms[at]).sum(axis=0))
        mine = {r.doc_id: r.score for r in got if r.item_id == q}
        assert set(mine) == set(np.argsort(-score)[:10]) and all(abs(score[d] - v) < 1e-4 for d, v in mine.items())


def test_hybrid_queries_with_the_semantic_run(spark, tmp_path):
    from factloom.plans.answers import QUERIES as ANSWERS
    from factloom.plans.retrieval import QUERIES

    texts = ["renal creatinine kidney function", "creatinine kidney clearance renal", "creatinine clearance estimate", "quality control level limits", "control limits quality lot", "quality lot control material", "glucose strip sugar", "sugar glucose reading"]
    rows = [(i, t, "kidney panel" if i < 3 else None, "Instructions For Use", "en") for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id bigint, text string, product string, doc_type string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "renal kidney")], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark_items.parquet")
    spark.createDataFrame([(7, "kidney panel", "renal")], "ref_id bigint, canonical_name string, family string").write.parquet(f"{tmp_path}/device_reference.parquet")
    run = lambda q, of=QUERIES: of[q](spark, str(tmp_path)).collect()
    assert {r.doc_id for r in run("rrf_fusion")} == {0, 1}  # two lexical runs
    fused = {r.doc_id: r.retrievers for r in run("rrf_fusion_semantic")}
    assert fused[2] == "semantic" and fused[0] == fused[1] == "bm25+semantic"  # shares no word with the question
    assert 2 in {r.doc_id for r in run("hybrid_faceted_semantic")}
    assert run("hybrid_diagnostics_semantic")[0].agreement < run("hybrid_diagnostics")[0].agreement == 1
    by_mode = {r["mode"]: r for r in run("evaluation_by_mode_semantic", ANSWERS)}
    assert set(by_mode) == {"lexical", "semantic", "hybrid"} and run("evaluation_gate_semantic", ANSWERS) and run("evaluation_by_category_semantic", ANSWERS)


def test_relevance_weighs_meaning_rivals_and_evidence(spark):
    from factloom.operators.semantic import SemanticIndex, with_similarity

    index = SemanticIndex(True, "", {"kidney": 0, "renal": 1, "battery": 2}, np.ones(3), np.array([[1.0, 0.0], [0.8, 0.6], [0.0, 1.0]]))
    said = ["Values of renal origin rise.", "A battery is inside.", "The glucose kidney result.", "The lactate kidney result.", "A kidney predicate device."]
    rows = [(1, ["kidney"], ["glucose"], "GENERAL", i, 1.0, 0, 100, s, 0.8, 1.0) for i, s in enumerate(said)] + [(1, ["kidney"], ["glucose"], "GENERAL", 9, 1.0, 0, 100, said[2], 0.8, 0.5)]
    df = spark.createDataFrame(rows, "query int, terms array<string>, focus array<string>, intent string, doc int, score double, pos int, total int, sentence string, quality double, prior double")
    got = {r.doc: r for r in A.sentence_relevance(with_similarity(df, index, spark.createDataFrame([(1, "kidney")], "query int, text string"))).collect()}
    assert set(got) == {0, 2, 3, 4, 9}  # the first is kept for its meaning alone
    assert abs(got[0].relevance - (0.22 * 0.8 + 0.12 * 0.8 + 0.06)) < 1e-6
    assert abs(got[3].relevance - 0.15 * (got[2].relevance - 0.16)) < 1e-5 and abs(got[4].relevance - 0.55 * (got[2].relevance - 0.16)) < 1e-5
    assert abs(got[9].final - got[2].final / 2) < 1e-5
    ok = [("The substances are listed below:", "prose", "GENERAL"), ("This section covers the meter.", "prose", "GENERAL"), ("a | b", "table", "GENERAL"), ("a | b", "table", "SPECIFICATION"), ("Keep it dry.", "prose", "GENERAL")]
    kept = spark.createDataFrame(ok, "s string, kind string, intent string").select(A.answerable("s", F.col("kind"), F.col("intent")).alias("k")).collect()
    assert [r.k for r in kept] == [False, False, False, True, True]


def docx() -> bytes:
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = lambda t, s="": f"<w:p>{f'<w:pPr><w:pStyle w:val={chr(34)}{s}{chr(34)}/></w:pPr>' if s else ''}<w:r><w:t>{t}</w:t></w:r></w:p>"
    xml = f"<w:document {w}><w:body>{p('Storage', 'Heading1')}{p('Keep the strips dry at room temperature always.')}{p('Power', 'Heading2')}{p('Tail text')}<w:tbl><w:tr><w:tc>{p('Cell')}</w:tc></w:tr></w:tbl></w:body></w:document>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", xml)
    return out.getvalue()


def test_parsers():
    assert text_paragraphs("STORAGE\nKeep dry\nand cool.\n\nDaily Care\n\nWipe it.")[0] == [("Keep dry and cool.", 1, ["STORAGE"]), ("Wipe it.", 1, ["STORAGE", "Daily Care"])]
    md = markdown_paragraphs("# Guide\n\nIntro *text*.\n\n## Use\n- first\n- second\n\n| a | b |\n|---|---|\n| c | d |\n\n```\ncode x\n```\n### Deep\nend")
    assert ("first", 1, ["Guide", "Use"]) in md and ("end", 1, ["Guide", "Use", "Deep"]) in md and any("c d" in t for t, _, _ in md) and any(t == "code x" for t, _, _ in md)
    assert html_paragraphs("<h1>A</h1><p>one <b>two</b></p><h2>B</h2><ul><li>x</li></ul><script>no</script>") == [("one two", 1, ["A"]), ("x", 1, ["A", "B"])]
    d = docx_paragraphs(docx())
    assert d[0][2] == ["Storage"] and d[1] == ("Tail text", 1, ["Storage", "Power"]) and d[2][0] == "Cell"


def test_sources_and_connectors(spark, tmp_path):
    folder = tmp_path / "docs"
    (folder / "manuals").mkdir(parents=True)
    (folder / "manuals" / "a.md").write_text("# Use\n\nThe meter is intended for the measurement of lactate in blood.\n\nshort")
    (folder / "b.docx").write_bytes(docx())
    (folder / "bad.docx").write_bytes(b"not a zip")
    (folder / "c.bin").write_bytes(b"x")
    (folder / "empty.txt").write_text("")
    rows = read_paragraphs(spark, str(folder)).collect()
    assert {r.document_name for r in rows} == {"a.md", "b.docx", "bad.docx"} and [r.document_name for r in rows if r.error] == ["bad.docx"]
    registry_dir = tmp_path / "csv"
    registry_dir.mkdir()
    (registry_dir / "510k_clearances.csv").write_text('k_number,device_name,applicant\nK1,"Meter, ""two"" lines\nlong",Acme\n,none,\n')
    both = registry([DocumentConnector(str(folder), domains={"manuals": "Technical"}), CsvConnector(str(registry_dir))], spark)
    got = both.collect()
    assert {r.domain for r in got if r.source_type == "document"} == {"Technical", "General"}
    assert [r.source_id for r in got if r.record_type == "clearance"] == ["K1"]
    assert registry([DocumentConnector("/nowhere"), CsvConnector("/nowhere")], spark) is None


def test_stream_merges_batches(spark, tmp_path):
    src = str(tmp_path / "in")
    for part in ([(1, "a1 b1 b1"), (2, "b1")], [(3, "b1 c1")]):
        spark.createDataFrame(part, "doc_id int, text string").coalesce(1).write.mode("append").parquet(src)
        q = follow(spark.readStream.schema("doc_id int, text string").parquet(src), str(tmp_path / "out"), str(tmp_path / "cp"))
        q.awaitTermination(120)
    assert {tuple(r) for r in merged(spark, str(tmp_path / "out")).collect()} == {("a1", 1, 1), ("b1", 3, 4), ("c1", 1, 1)}
