"""Pieces, pairs, repeated lines, leakage and truncation against brute force and edge cases."""

import itertools
import random
import re
from collections import Counter, defaultdict

import pytest

from factloom.llm.cooccurrence import item_pairs
from factloom.llm.furniture_lines import repeated_lines, without_repeated_lines
from factloom.llm.leakage import WuManber, leaked_items, words
from factloom.llm.pieces import split_oversized
from factloom.llm.truncation import open_structures, truncated_documents, truncation_by_source, without_marks


def test_pieces_give_back_the_text(spark):
    rnd = random.Random(1)
    vocab = ["alpha", "beta,", "gamma.", "δelta;", "x" * 40, "\n", "\n\n", "𝒳𝒴", "日本語"]
    texts = [" ".join(rnd.choice(vocab) for _ in range(n)) for n in (5, 60, 300, 2000)] + ["y" * 5000, " " * 3000, "𝒳" * 2500, None, "", "z" * 1000, "z" * 1001]
    df = spark.createDataFrame([(i, t, "c") for i, t in enumerate(texts)] * 2, "id int, text string, piece string")
    got = defaultdict(list)
    for r in split_oversized(df, ["id"]).orderBy("id", "piece_no").collect():
        got[r.id].append(r)
    assert set(got) == {i for i, t in enumerate(texts) if t and len(t) > 1000}
    for i, rows in got.items():
        assert [r.piece_no for r in rows] == list(range(1, len(rows) + 1)) and rows[0].n_pieces == len(rows)
        assert all(len(r.piece) <= 1000 and r.lead <= 100 for r in rows)
        assert "".join(r.piece[r.lead:] for r in rows) == texts[i]
        assert all(a.piece.endswith(b.piece[: b.lead]) for a, b in itertools.pairwise(rows))


def test_pieces_prefer_strong_boundaries(spark):
    text = "w " * 300 + "end.\n\n" + "v " * 300
    first = split_oversized(spark.createDataFrame([(1, text)], "id int, text string"), ["id"]).where("piece_no = 1").first()
    assert first.piece.endswith("end.\n\n")
    with pytest.raises(ValueError):
        split_oversized(spark.createDataFrame([(1, text)], "id int, text string"), ["id"], overlap=1000)


def test_pieces_of_a_very_long_text(spark):
    text = "".join(f"Sentence number {i} of this text ends here. " for i in range(20_000))
    rows = split_oversized(spark.createDataFrame([(1, text), (1, text[:5000])], "id int, text string"), ["id"], limit=60, overlap=40).orderBy("n_pieces", "piece_no").collect()
    whole = [r for r in rows if r.n_pieces > 1000]
    assert "".join(r.piece[r.lead:] for r in whole) == text and all(text[r.start:].startswith(r.piece[r.lead:]) for r in whole)
    assert all(len(r.piece) <= 60 for r in rows) and len(rows) > len(whole)


def test_pairs_against_brute_force(spark):
    rnd = random.Random(2)
    rows = [(rnd.randrange(400), rnd.choice(["Hot"] * 9 + [f" i{rnd.randrange(9)} ", "", None, f"P{rnd.randrange(4)}"])) for _ in range(3000)]
    rows += [(7, f"q{i}") for i in range(200)] + [(8, f"Q{i}") for i in range(200)] + [(None, "a")]
    got = {tuple(r)[:5] for r in item_pairs(spark.createDataFrame(rows * 2, "b int, n_ab string"), "b", "n_ab", min_count=2, min_lift=1.2).collect()}
    sets = defaultdict(set)
    for b, i in rows:
        if b is not None and i and i.strip():
            sets[b].add(i.strip().lower())
    n, one = len(sets), Counter(i for s in sets.values() for i in s)
    two = Counter(p for s in sets.values() for p in itertools.combinations(sorted(s), 2))
    want = {(a, b, one[a], one[b], k) for (a, b), k in two.items() if k >= 2 and k >= 0.001 * n and k * n >= 1.2 * one[a] * one[b]}
    assert got == want and len(want) > 1000
    assert item_pairs(spark.createDataFrame([], "b int, i string"), "b", "i").count() == 0


def _lines(rows):
    norm = lambda x: re.sub("[0-9]+", "0", re.sub("[ \t\r]+", " ", x.lower()).strip(" "))
    docs, size, where = defaultdict(set), defaultdict(set), []
    for item, doc, src, path, text in rows:
        size[src].add(doc)
        for no, raw in enumerate((text or "").split("\n") if text is not None else [], 1):
            line = norm(raw)
            if line and line not in [norm(p) for p in path or []]:
                docs[src, line].add(doc)
                where.append((item, no, src, line))
    return {(i, no) for i, no, s, x in where if len(docs[s, x]) >= 5 and len(docs[s, x]) >= 0.04 * len(size[s])}


def test_repeated_lines_against_brute_force(spark):
    rnd = random.Random(3)
    pool = ["Share this page", "Page  3 of 9\r", "\tAll rights reserved 2020", "Intro", "", "body one two", "x" * 5000]
    rows = [(i, rnd.randrange(60), rnd.choice(["a", "a", "a", None]), rnd.choice([["Intro"], [], None]), "\n".join(rnd.choice(pool + [f"own line {i} of text here"]) for _ in range(4))) for i in range(150)]
    rows += [(900, 1, "a", [], None), (901, 2, "a", None, "")]
    df = spark.createDataFrame(rows * 2, "id int, doc int, src string, section_path array<string>, text string").selectExpr("*", "'n' AS node", "1 AS line")
    every, templates = repeated_lines(df, "id", "doc", "src")
    hits = every.where("literal")
    assert {(r["item"], r.line_no) for r in hits.collect()} == _lines(rows)
    assert templates.count() > 0
    clean = {r.id: r.text for r in without_repeated_lines(df, hits, "id").collect()}
    gone = _lines(rows)
    for item, _, _, _, text in rows:
        assert clean[item] == (None if text is None else "\n".join(x for n, x in enumerate(text.split("\n"), 1) if (item, n) not in gone))
    empty = spark.createDataFrame([], df.schema)
    assert repeated_lines(empty, "id", "doc", "src")[0].count() == 0


def test_templates_with_a_changing_word(spark):
    rnd = random.Random(7)
    rows = [(i, i, "a", [], "\n".join(rnd.sample([f"shared by name{chr(97 + i % 26)}{chr(97 + i // 26)} on the portal today", "terms of use", f"w{chr(97 + i // 26)}{chr(97 + i % 26)} k{chr(97 + i % 26)}{chr(97 + i // 26)}x b"], 3))) for i in range(100)]
    hits, templates = repeated_lines(spark.createDataFrame(rows, "id int, doc int, src string, section_path array<string>, text string"), "id", "doc", "src")
    assert {(r.template, r.documents, r.literal) for r in templates.collect()} == {("shared by <*> on the portal today", 100, False), ("terms of use", 100, True)}
    want = {(i, no) for i, _, _, _, t in rows for no, x in enumerate(t.split("\n"), 1) if x.startswith(("shared", "terms"))}
    assert {(r["item"], r.line_no) for r in hits.collect()} == want


def test_leaks_against_brute_force(spark):
    rnd = random.Random(4)
    vocab = ["one", "two", "Three", "four", "fünf", "six7"]
    text = lambda n: "".join(rnd.choice(vocab) + rnd.choice([" ", ", ", "\n", "-"]) for _ in range(n))
    items = [(i, text(rnd.choice([3, 12, 30]))) for i in range(40)] + [(98, None), (99, "")]
    docs = [(i, text(40)) for i in range(200)] + [(500 + i, text(20) + items[i][1].upper() + text(20)) for i in range(20)] + [(900, None), (901, ""), (902, "word " * 50_000)]
    got = {tuple(r) for r in leaked_items(spark.createDataFrame(docs * 2, "d int, text string"), spark.createDataFrame(items, "i int, text string"), "d", "i").collect()}
    grams = lambda w: {tuple(w[k: k + 12]) for k in range(len(w) - 11)}
    of = lambda rows: [(k, grams(words(t or ""))) for k, t in rows]
    held, sought = of(docs), of(items)
    want = {(i, d) for i, a in sought for d, b in held if a & b}
    assert got == want and want
    parts = leaked_items(spark.createDataFrame(docs, "d int, text string"), spark.createDataFrame(items, "i int, text string"), "d", "i", part_words=100)
    assert {tuple(r) for r in parts.collect()} == want  # a set searched in parts
    assert WuManber([], 12).search("any text " * 20) == set()
    assert leaked_items(spark.createDataFrame([], "d int, text string"), spark.createDataFrame([], "i int, text string"), "d", "i").count() == 0


def test_stack_automaton():
    assert open_structures("a (b [c] d") == "(" and open_structures("(a) “b” <i>x</i>") == ""
    assert open_structures("see <a href='x") == "<" and open_structures("") == ""
    assert open_structures('<div class="a">\nHe paid (in full.\nAll done.') == "<div>(" and open_structures('She said "all is well.\nDone.') == '"'
    assert open_structures('{"a": [1, 2\nDone.') == "{[" and open_structures('{"a": [1, 2]}') == "" and open_structures('a 5" tube, \\"x') == "" and open_structures("1) one\n2) two") == ""
    assert without_marks("All went to th... [more] ") == ("All went to th", True) and without_marks("spread more") == ("spread more", False) and without_marks("x" + "." * 9000) == ("x", True)


def test_structures_are_judged_by_the_source(spark):
    rows = [(i, "tidy", f"Note {i} (see above) is closed.\nAll was checked twice, part {i}.") for i in range(60)] + [(100, "tidy", "The list (one, two.\nAll was checked twice, part 9.")]
    rows += [(200 + i, "loose", f"Note {i} (see above is not closed.\nAll was checked twice, part {i}.") for i in range(30)]
    rows += [(300, "alone", '<div class="a">\nText of a page.'), (301, "lone", '{"a": [1, 2\nText of a page.'), (302, "single", 'He said "it is\nText of a page.')]
    got = {r.doc_id: r for r in truncated_documents(spark.createDataFrame(rows, "doc_id int, source string, text string"), "doc_id", "source").collect()}
    assert {i for i, r in got.items() if r.truncated} == {100, 300, 301, 302} and got[100].reasons == "structure"


def test_truncation(spark):
    end = ["This one is complete.", "Quality Control\nAll was checked twice.", "All was well today.\n- lint-free cloth", "Done with it.\nApproved for release 2019"]
    cut = ["The reading was hig", "The result of the", "Values are [more]", "All went to th...", "Die Proben sind �", "He said (as of"]
    rows = [(i, "s", end[i % 4].replace("today", f"today {i}").replace("with it", f"with {i} parts")) for i in range(80)] + [(100 + i, " S ", f"Case {i} here. " + c) for i, c in enumerate(cut)]
    rows += [(200, None, None), (201, "s", ""), (202, "s", "  \n "), (203, "s", "A sentence of many words goes on. " * 3000)]
    rows += [(300 + i, "fixed", (f"Sentence number {i} is here and goes on for quite a while ab")[:50]) for i in range(10)]
    df = spark.createDataFrame(rows * 2, "doc_id int, source string, text string").selectExpr("*", "1 AS line", "'x' AS body", "2 AS limit")
    got = {r.doc_id: r for r in truncated_documents(df, "doc_id", "source").collect()}
    assert len(got) == len(rows)
    assert {i for i, r in got.items() if r.truncated} == {100 + i for i in range(len(cut))} | {300 + i for i in range(10)}
    assert "limit" in got[300].reasons and "bytes" in got[104].reasons and "mark" in got[102].reasons
    shares = {r.source: r.share for r in truncation_by_source(spark.createDataFrame(list(got.values()))).collect()}
    assert shares["fixed"] == 1.0
    assert truncated_documents(spark.createDataFrame([], df.schema), "doc_id", "source").count() == 0


def test_truncation_of_a_source_that_is_mostly_cut(spark):
    rnd = random.Random(4)
    words_ = [f"{a}{b}" for a in ("mor", "tal", "ven", "sip", "gar", "lud") for b in ("ike", "ond", "ather", "isp", "elm")]
    prose = lambda sep: sep.join(" ".join(["The", *rnd.choices(words_, k=rnd.randint(6, 14))]) + "." for _ in range(8))
    stop = lambda t: t[: rnd.randint(len(t) // 3, len(t) - 3)].rstrip(". \n")
    rows = [(i, "cut", stop(prose(" ")) if i % 20 else prose(" ")) for i in range(400)] + [(400 + i, "cut lines", stop(prose("\n")) if i % 20 else prose("\n")) for i in range(400)]
    title = lambda n: " ".join(rnd.choices(words_, k=n)).title()
    rows += [(800 + i, "titles", title(i + 3)) for i in range(60)] + [(900 + i, "titles", f"{title(2 * i)} meter reviewed by the") for i in range(3)]  # no length is shared
    rows += [(1000 + i, "signed", " ".join([prose(" ")] * (i + 1)) + "\n" + title(2)) for i in range(60)]
    got = {r.doc_id: r.truncated for r in truncated_documents(spark.createDataFrame(rows, "doc_id int, source string, text string"), "doc_id", "source").collect()}
    found = {i for i, t in got.items() if t}
    cut = {i for i in range(800) if i % 20}
    assert found - cut == {900, 901, 902}
    assert all(len(found & part) >= 0.95 * len(part) for part in ({i for i in cut if i < 400}, {i for i in cut if i >= 400}))  # stumps of a few letters that many texts share remain
