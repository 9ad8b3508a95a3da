"""Graph contribution, composition, extraction, gold matchers, sources and sinks on small fixtures."""

import json

import pytest
from pyspark.sql import functions as F

from factloom.operators import answers as A
from factloom.operators import composition as C
from factloom.operators import evaluation as E
from factloom.operators import lineage as X
from factloom.operators.extraction import extracted_entities
from factloom.operators.fusion import explained
from factloom.operators.lexical import build_index, load_index, save_index
from factloom.session import shared_dir
from factloom.sources import verbalise as V
from factloom.sources.connectors import CsvConnector, file_doc_type, file_k_number, file_product
from factloom.sources.sinks import read_gold, read_json, write_json, write_report


def values(spark, rows, kinds, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, kinds).select(*columns).collect()]


def test_clean_sentences(spark):
    cases = {
        "1.4 Accuracy The meter reads within five percent.": "The meter reads within five percent.",
        "AppendixMethodology The sample is drawn first.": "The sample is drawn first.",
        "Accuracy of the system was assayed with blood.": "Accuracy of the system was assayed with blood.",
        "Accuracy Accuracy of the strip is stated .": "Accuracy of the strip is stated.",
        "the  value ( given ) stands.": "The value (given) stands.", "": "", "Zorvath Meter 1.4 The sample is whole blood.": "The sample is whole blood.",
    }
    got = values(spark, [(k,) for k in cases] + [(None,)], "t string", "t", C.clean_sentence("t"))
    assert {k: v for k, v in got if k is not None} == cases and (None, None) in got


def test_formatting(spark):
    row = values(spark, [("the Reading", "FDA says", "a_b guide.pdf", "<a & 'b'>", ["glucose", "meter"])], "a string, b string, c string, d string, e array<string>",
                 C.decapitalised("a"), C.decapitalised("b"), C.short_label("c"), C.escaped_html("d"), C.subject_phrase("e"), C.title_case("a"))[0]
    assert row == ("the Reading", "FDA says", "a b guide", "&lt;a &amp; &#39;b&#39;&gt;", "Glucose", "The Reading")
    stems = values(spark, [(w,) for w in ("batteries", "measuring", "glass", "strips", "used")], "w string", C.bank_stem("w"))
    assert [s for s, in stems] == ["battery", "measur", "glass", "strip", "us"] or [s for s, in stems][:4] == ["battery", "measur", "glass", "strip"]


def test_markers_and_reply(spark):
    rows = [(1, 1, "c1", 10, 0, "The meter reads glucose.", 0.9), (1, 2, "c1", 10, 1, "A second fact stands here.", 0.8), (1, 3, "c2", 11, 0, "Do not use it twice.", 0.7), (1, 4, "c2", 11, 9, "A later fact of it.", 0.6), (1, 5, "c3", 12, 0, "Another one.", 0.5)]
    picks = spark.createDataFrame(rows, "query int, pick int, chunk string, document int, position int, sentence string, final double")
    got = [(r.relation, r.marker) for r in C.marked(picks).orderBy("pick").collect()]
    assert got == [(None, None), ("continue", "It adds that"), ("contrast", "However,"), ("specify", "Specifically,"), ("corroborate", "Separately,")]
    asked = spark.createDataFrame([(1, "INTERFERENCE", ["glucose"])], "query int, intent string, focus array<string>")
    r = C.composed_reply(picks, asked).first()
    assert r.opener == "On interference affecting Glucose, the documentation states — drawn from 3 documents:" and r.documents == 3
    assert r.body.startswith("The meter reads glucose. [1] It adds that a second fact stands here. [1] However, do not use it twice. [2]")
    moved = [x.sentence for x in C.reading_order(picks.withColumn("final", F.when(F.col("document") == 12, 2.0).otherwise(F.col("final")))).orderBy("pick").collect()]
    assert moved[0] == "Another one."
    said = asked.select(C.no_answer(F.col("intent"), F.col("focus"), F.lit(2), F.lit("Guide"))).first()[0]
    assert "2 passages matched" in said and "interference findings" in said and said.endswith("Guide.")
    assert values(spark, [(20.0, 1.0), (80.0, 0.1), (80.0, 0.9)], "p double, c double", C.closing(F.col("p"), F.col("c"), F.lit(1.0), F.lit(0)).isNull()) == [(False,), (False,), (True,)]


def test_graph_contribution(spark):
    cited = spark.createDataFrame([(1, 10), (1, 11), (1, 12), (2, 10)], "query int, document int")
    linked = spark.createDataFrame([("glucose", 10), ("glucose", 11), ("sodium", 10), ("sodium", 11), ("sodium", 12), ("rare", 99)] + [("sodium", d) for d in range(20, 60)], "entity string, document int")
    focus = spark.createDataFrame([(1, ["glucose"]), (2, None)], "query int, focus array<string>")
    joining = X.bridges(cited, linked, 100, focus, spark.createDataFrame([("sodium",)], "entity string"))
    rows = joining.orderBy("place").collect()
    assert [(r.query, r.entity, r.shared, r.reach, r.on_topic) for r in rows] == [(1, "glucose", 2, 2, True), (1, "sodium", 3, 43, False)]
    assert rows[0].weight == round(3 + 1.5 * 0.98 + 2 / 3, 6)
    texts = spark.createDataFrame([(1, 10, "alpha beta gamma"), (1, 11, "delta epsilon zeta"), (1, 12, "alpha beta gamma")], "query int, document int, text string")
    pairs = X.weak_pairs(cited, texts, joining, linked).orderBy("place").collect()
    assert [(r.a, r.b, r.via, r.graph_only) for r in pairs] == [(10, 11, "glucose", True), (11, 12, "sodium", True), (10, 12, "sodium", False)]
    assert X.bridges(cited.where("query = 2"), linked, 100, focus, spark.createDataFrame([], "entity string")).count() == 0
    assert tuple(X.graph_purpose(linked, spark.createDataFrame([("sodium",)], "entity string")).first()) == (3, 2, 1)
    m = spark.createDataFrame([("A ", 1, 5), ("a", 1, 5), (None, 1, 5), ("", 1, 5), ("B", 1, 5), ("b", None, 6)], "canonical string, document_id int, chunk_id int")
    assert {tuple(r) for r in X.entity_documents(m).collect()} == {("a", 1, 1), ("b", 1, 1)}
    assert {(r.chunk, tuple(r.entities)) for r in X.chunk_entities(m).collect()} == {(5, ("a", "b")), (6, ("b",))}
    c = spark.createDataFrame([(1, "x" * 90, ["References"]), (2, "x" * 90, ["Use"]), (3, "x", None)], "chunk_id int, text string, section_path array<string>")
    assert X.demo_chunk(c, F.col("chunk_id") == 1).first()[0] == 2 and X.demo_chunk(c.where("chunk_id = 3"), F.lit(False)).first()[0] == 3


def test_extracted_entities(spark):
    df = spark.createDataFrame([(1, "The Zorvath Meter was checked by FDA. Informação and It. Über"), (2, None), (3, "")], "k int, text string")
    got = [(r.k, r.name, r.canonical, r.kind) for r in extracted_entities(df, "k").orderBy("k", "pos").collect()]
    assert got == [(1, "Zorvath Meter", "zorvath meter", "proper_noun"), (1, "FDA", "fda", "proper_noun"), (1, "FDA", "fda", "acronym")]


def test_cohesion(spark):
    rows = [(1, "a1", 1, 9.0, "guide", ["guide"], False), (1, "a2", 2, 8.0, "guide", ["guide"], False), (1, "b1", 3, 3.0, "other", ["other"], False), (1, "f1", 4, 2.0, "junk", ["junk"], True),
            (2, "a1", 1, 5.0, "guide", ["guide"], False), (2, "b1", 2, 4.5, "other", ["other"], False)]
    ranked = spark.createDataFrame(rows, "query int, doc string, rank int, score double, document string, name_tokens array<string>, furniture boolean")
    asked = spark.createDataFrame([(1, ["lactate"]), (2, ["lactate"])], "query int, terms array<string>")
    rare = spark.createDataFrame([(1, True), (2, False)], "query int, rare boolean")
    got = A.cohered(ranked, asked, rare).orderBy("query", "place").collect()
    assert [(r.query, r.doc) for r in got] == [(1, "a1"), (1, "a2"), (2, "a1"), (2, "b1")]
    assert got[0].confident and got[0].distinctness == 3.0 and not got[2].confident
    named = A.cohered(ranked, spark.createDataFrame([(2, ["other"])], "query int, terms array<string>"), rare).collect()
    assert [(r.doc, r.confident, r.confidence) for r in named] == [("b1", True, 0.75)]
    terms = spark.createDataFrame([("lactate", 2), ("meter", 90), ("meters", 3)], "term string, df int")
    q = spark.createDataFrame([(1, "lactate"), (2, "meter"), (3, "the"), (4, "metre")], "query int, term string")
    v = spark.createDataFrame([("metre", "meters")], "term string, variant string")
    assert {tuple(r) for r in A.rare_terms(q, terms, 100, v).collect()} == {(1, True), (2, False), (3, False), (4, True)}


def test_retry_and_caveats(spark):
    first = spark.createDataFrame([(1, 30.0), (2, 80.0), (3, 20.0), (4, 20.0)], "query int, percent double")
    bank = spark.createDataFrame([(1, 9, 0.5), (2, 9, 0.8), (3, 9, 0.3)], "query int, entry int, similarity double")
    got = {r.query: (r.asked, r.percent) for r in A.retried(first, bank, spark.createDataFrame([(9, 60.0)], "entry int, percent double")).collect()}
    assert got == {1: (9, 60.0), 2: (9, 60.0), 3: (None, 20.0), 4: (None, 20.0)}
    low = {n: F.lit(0.1) for n in ("margin", "agreement", "coverage", "consensus", "quality")}
    row = spark.range(1).select(A.caveats(low, F.lit(True), F.lit("GENERAL")), A.plain_verdict(F.lit(50.0), low)).first()
    assert len(row[0]) == 6 and row[1].startswith("Reasonable answer, with caveats. 0 of 5")


def test_gold_cases(spark, tmp_path):
    (tmp_path / "gold.yaml").write_text(json.dumps({"cases": [
        {"id": "a", "question": "q", "category": "x", "relevant_any": [{"text_contains": ["LACTATE", "none"]}, {"product": "Zorvath"}]},
        {"id": "b", "question": "q", "relevant_all": [{"text_contains": "lactate"}, {"product": "missing"}]}, {"id": "c", "question": "", "expect_empty_or_low": True}]}))
    cases, matchers = read_gold(spark, str(tmp_path / "gold.yaml"))
    ranked = spark.createDataFrame([("a", 1, 1), ("a", 2, 2), ("b", 2, 1)] + [("c", i, i) for i in range(1, 6)], "query string, doc int, rank int")
    chunks = spark.createDataFrame([(i, "about lactate" if i == 2 else None, {"product": "other"}) for i in range(1, 6)], "doc int, text string, fields map<string,string>")
    got = {r.query: r for r in E.scored_cases(ranked, E.matcher_hits(ranked, chunks, matchers), cases).collect()}
    assert (got["a"].recall_5, got["a"].mrr, got["a"].ndcg_10) == (1.0, 0.5, round(1 / 1.5849625007, 6))
    assert (got["b"].recall_10, got["b"].mrr, got["b"].cross_source_satisfied) == (0.5, 0.0, False)
    assert got["c"].robustness is False and got["c"].recall_5 == 0.0
    means = spark.createDataFrame([("hybrid", 0.9), ("lexical", 0.6)], "mode string, recall_10 double")
    assert tuple(E.uplift(means).first()) == ("recall_10", 0.3, 50.0)
    write_report({"means": means}, str(tmp_path / "r.json"))
    assert len(json.loads((tmp_path / "r.json").read_text())["means"]) == 2
    write_json(means, str(tmp_path / "j"))
    assert {tuple(r) for r in read_json(spark, str(tmp_path / "j"), "mode string, recall_10 double").collect()} == {("hybrid", 0.9), ("lexical", 0.6)}


def test_index_is_saved_and_loaded(spark, tmp_path):
    index = build_index(spark.createDataFrame([(1, "alpha beta beta"), (2, "alpha"), (2, "alpha"), (3, ""), (4, None)], "id int, text string"), "id")
    assert tuple(index.stats.first()) == (4, 1.0)
    save_index(index, str(tmp_path / "i"))
    again = load_index(spark, str(tmp_path / "i"))
    assert {tuple(r) for r in again.postings.collect()} == {tuple(r) for r in index.postings.collect()} == {(1, 3, "alpha", 1), (1, 3, "beta", 2), (2, 1, "alpha", 1)}
    assert {(r.term, r.df) for r in again.terms.collect()} == {("alpha", 2), ("beta", 1)} and load_index(spark, str(tmp_path / "none")) is None


def test_registries(spark, tmp_path):
    (tmp_path / "device_recalls.csv").write_text("product_res_number,event_date_initiated,product_description,reason_for_recall,root_cause_description,recall_status,product_code\n,2020-01-02,Meter,Wrong,Software design,Open,ABC\n")
    (tmp_path / "udi_device_identifiers.csv").write_text("brand_name,version_or_model_number,device_description,product_codes,commercial_distribution_status,publish_date\nZorvath,M1,Meter,ABC;DEF,Active,2021\nZorvath,M1,Again,XYZ,Active,2022\n,M2,x,y,z,2020\n")
    (tmp_path / "nova_ifu_document_index.csv").write_text("family,product,doc_type,title,literature_part_number,url\nMeter,Zorvath,IFU,Zorvath Guide,LPN1,\nMeter,Zorvath,IFU,Another title that is longer than thirty,,http://x\n")
    rows = {r.source_id: r for r in CsvConnector(str(tmp_path)).read(spark).collect()}
    assert set(rows) == {"RECALL-2020-01-02", "UDI-Zorvath-M1", "IFU-LPN1", "IFU-Another title that is longer t"}
    assert rows["RECALL-2020-01-02"].severity_signal == "software" and rows["UDI-Zorvath-M1"].product_code == "ABC"
    assert V.device_identifiers(spark.createDataFrame([], "brand_name string, version_or_model_number string, device_description string, product_codes string, commercial_distribution_status string, publish_date string")).count() == 0
    names = [("K123456_review_x.pdf",), ("k12_summary.pdf",), ("Zorvath_Quick_Reference.pdf",), ("zorvath_ifu.pdf",), ("plain.txt",)]
    got = values(spark, names, "n string", file_doc_type("n"), file_k_number("n"), file_product("n", (("zorvath", "Zorvath"),)))
    assert got == [("Review Memorandum", "K123456", "Unclassified"), ("510(k) Summary", "", "Unclassified"), ("Quick Reference Guide", "", "Zorvath"), ("Instructions For Use", "", "Zorvath"), ("Document", "", "Unclassified")]


def test_explained_fusion(spark):
    runs = spark.createDataFrame([(1, "bm25", "d", 3.0, 1, 1.0), (1, "semantic", "d", 0.5, 2, 1.0), (1, "semantic", "e", 0.6, 1, 1.0)], "query int, retriever string, doc string, score double, rank int, weight double")
    r = explained(runs).where("doc = 'd'").first()
    assert r.ranks == {"bm25": 1, "semantic": 2} and r.explanation == "bm25 #1 (+0.016393), semantic #2 (+0.016129)"


def test_no_machine_local_folder_on_a_cluster():
    class Conf:
        def get(self, *_):
            return None

    class Session:
        conf = Conf()
        sparkContext = type("C", (), {"master": "spark://host:7077"})()

    with pytest.raises(ValueError):
        shared_dir(Session())
