"""Scalar text functions, sentences, repair and dates."""

from pyspark.sql import functions as F

from factloom.functions.sentences import Counts, repair, repaired_text, sentences, split_sentences
from factloom.functions.text import classify_sentence, containment, degenerate, jaccard, looks_like_heading, name_tokens, sanitize, stem_prefix, tokens
from factloom.operators.structure import dated


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first()["y"]


def test_tokens_and_names(spark):
    assert one(spark, "The BM25 index, a b!", tokens) == ["the", "bm25", "index"]
    assert one(spark, None, tokens) is None and one(spark, "", tokens) == []
    assert one(spark, "Meter_Guide-2021_v2.pdf", name_tokens) == ["meter", "guide", "v2"]


def test_sanitize_and_degenerate(spark):
    assert [one(spark, v, sanitize) for v in ("  a \n b ", " N/A ", "nan", None, "")] == ["a b", "", "", "", ""]
    assert [one(spark, v, degenerate) for v in ("the", "", "   ", "!!!", "a", None, "the lactate")] == [True] * 6 + [False]


def test_headings(spark):
    assert [one(spark, v, looks_like_heading) for v in ("QUALITY CONTROL", "Intended Use", "This is a sentence.", "lower case words", "AB", "", None, "X" * 90)] == [True, True, False, False, False, False, False, False]


def test_stems(spark):
    assert [one(spark, v, stem_prefix) for v in ("batteries", "measuring", "strips", "lens", "red", "glass")] == ["batter", "measur", "strip", "lens", "red", "glass"]


def test_set_measures(spark):
    df = spark.createDataFrame([(["a", "b"], ["b", "c"]), ([], [])], "x array<string>, y array<string>")
    assert [tuple(r) for r in df.select(jaccard("x", "y"), containment("x", "y")).collect()] == [(1 / 3, 0.5), (0.0, 0.0)]


def test_sentences(spark):
    text = "See Fig. 3 for details. J. Smith wrote it. Measured at 1.2 uL.\nNext line here. " + "word " * 100
    out = split_sentences(text)
    assert out[:4] == ["See Fig. 3 for details.", "J. Smith wrote it.", "Measured at 1.2 uL.", "Next line here."]
    assert all(len(s) <= 340 for s in out) and split_sentences("") == [] and split_sentences(None) == []
    assert split_sentences("Parts: • one • two • three") == ["Parts:", "one", "two", "three"]
    rows = sentences(spark.createDataFrame([(1, text), (2, None), (3, "")], "id int, t string"), "id", "t").collect()
    assert {r.id for r in rows} == {1} and all(text[r.offset: r.offset + r.length].replace("\n", " ") == r.sentence for r in rows)
    assert split_sentences("It is fine (A.B. said). U.S. rules apply! Really? Yes") == ["It is fine (A.B. said).", "U.S. rules apply!", "Really?", "Yes"]
    listed = "Contents of the box " + "and some more of it " * 16 + "1) Open the lid 2) Close the lid again"
    assert split_sentences(listed)[-2:] == ["1) Open the lid", "2) Close the lid again"]


def test_sentence_kinds(spark):
    cases = [("Short one.", "fragment"), ("The meter is intended for use with whole blood samples only.", "prose"), ("Copyright 2020 by the makers of this device.", "legal"),
             ("Quick Reference Guide.........12", "header"), ("Storage And Handling Of The Strips", "header"), ("10.2 11.3 12.4 13.5 14.6 15.7 16.8", "equation"), ("Level 10.2 11.3 12.4 mean of all those", "table")]
    df = spark.createDataFrame(cases, "s string, want string")
    assert all(r.kind == r.want and 0 <= r.q <= 1 for r in df.withColumn("g", classify_sentence("s", 3)).select("want", "g.kind", F.col("g.quality").alias("q")).collect())
    assert spark.createDataFrame([("The reading of the strip was hig",)], "s string").select(classify_sentence("s", 0)["kind"]).first()[0] == "fragment"


def test_repair():
    vocab = {"measurement": 50, "surement": 1, "mea": 1, "responsible": 9, "appendix": 4, "accuracy": 6, "sample": 20, "samples": 8, "in": 900, "take": 40, "intake": 3}
    assert repair("Mea surement of AppendixAccuracy", vocab) == "Measurement of Appendix Accuracy"
    assert repair("re - sponsible and point -of-care", vocab) == "responsible and point-of-care"
    assert repair("in take of sample s .", vocab) == "in take of samples."
    assert repair("Page 3 of 9 The text", vocab) == "The text" and repair("", vocab) == ""
    assert repair("The rate is 5 % here. K123456 - Page 4 of 9 It goes on", vocab) == "The rate is 5% here. It goes on"
    assert repair("AppendixAccuracy", vocab, frozenset({"appendixaccuracy"})) == "AppendixAccuracy" and repair("a\n\n\n\nb ﬁne", vocab) == "a\n\nb fine"


def test_counts_travel_as_hashes(spark):
    rows = [(f"w{i}", i) for i in range(2, 900)] + [("größe", 7)]
    c = Counts.of(spark.createDataFrame(rows, "word string, n bigint"))
    assert all(c.get(w, 0) == n for w, n in rows) and c.get("none", 0) == 0 and len(c) == len(rows)
    got = repaired_text(spark.createDataFrame([(1, "mea surement"), (2, None)], "id int, text string"), "id", spark.createDataFrame([("measurement", 5)], "word string, n bigint"))
    assert {tuple(r) for r in got.collect()} == {(1, "measurement"), (2, None)}


def test_dates(spark):
    rows = [("2024-05-31", "", "2024-05-31", "regulatory"), ("1998-01-02", "Issued 2019-02-30 now", "2019-02-28", "document_control"), (None, "Seen 2021-13-40.", "2021-12-28", "text_date"),
            ("bad", "From March 2018", "2018-03-01", "text_date"), (None, None, None, "unknown"), ("", "none", None, "unknown")]
    df = spark.createDataFrame(rows, "r string, t string, d string, m string")
    assert all((x.x.date, x.x.method) == (x.d, x.m) for x in df.select("d", "m", dated(F.col("r"), F.col("t")).alias("x")).collect())
