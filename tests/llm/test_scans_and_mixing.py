"""Scan repair on held-out synthetic noise, and exact budgets."""

import random

from factloom.llm import scans
from factloom.llm.mixing import fit_budget, mixture, plan_mixture, subset_sum
from factloom.llm.scans import Editor, Perceptron, learned_channel, repaired

SENTENCES = ["The laboratory supervisor should verify that the battery door has been aligned at the bedside.", "Allow the membrane cap to equilibrate for 15 hours before venous plasma is introduced.",
             "An updated deviation report was mailed to the operator at every site that had received the reagent pack.", "Wipe the waste bottle with a lint-free cloth and request a new thermal printer.",
             "Training in the neonatal unit covers sample collection and the complaint file.", "Vitamin B12, pO2 and H2O2 were not tested."]
SCHEMA = "pid int, doc int, text string, page int, section_path array<string>"


def corpus():
    rnd, rows, truth = random.Random(8), [], {}
    for i in range(600):
        text = " ".join(rnd.choice(SENTENCES) for _ in range(4))
        rows.append((i, i // 10, text, i % 7, ["Zorvath Meter"]))
    noisy = [
        ("should ver!fy that the battery door has been a1igned\nat the bedside.", 2, {"misread"}),
        ("should verify that the bat-\ntery door has been aligned at the bedside.", 2, {"hyphenation"}),
        ("Wipe the waste bottle with a lint-\nfree cloth and request a new thermal printer.", 2, set()),
        ("Allow the membrane cap to\nAcme Corporation   Document 77\nequilibrate for 15 hours before venous plasma is introduced.", 2, {"running_header"}),
        ("Allow the membrane cap to equili¬\n- 2 -\nbrate for 15 hours before venous plasma is introduced.", 2, {"hyphenation", "page_number"}),
        ("Allow the membrane cap to\nAcme Corporation   Document 77  Page 3\nequilibrate for 15 hours before venous plasma is introduced.", 3, {"running_header", "page_number"}),
        ("Allow the membrane cap to\nequilibrate for 15 hours before venous plasma is introduced.\nSee page 3 for details.", 3, set()),
        ("", 1, set()), ("The " * 20_000, 1, set()),
    ]
    for k in range(20):
        for j, (t, page, kinds) in enumerate(noisy):
            if j == 0 and k:
                continue  # a recognition error is rare among the right spellings
            pid = 1000 + k * 20 + j
            rows.append((pid, 77, t, page, None))
            truth[pid] = kinds
    return rows, truth


def test_repair_finds_each_kind_of_noise(spark):
    rows, truth = corpus()
    extra = [(5000, 1, None, 1, None), (None, 1, "text", 1, None), (5001, None, "A line of text\nand one more line.", None, None)]
    df = spark.createDataFrame((rows + extra) * 2, SCHEMA).selectExpr("*", "1 AS repeats", "'x' AS head", "3 AS item")
    got = {r.pid: r for r in repaired(df, "pid", "doc").collect()}
    assert set(got) == {r[0] for r in rows} | {5001}
    assert {p: set(got[p].noise) for p in truth} == truth
    assert all(not got[i].noise for i in range(600))
    assert got[1004].text == "Allow the membrane cap to equilibrate for 15 hours before venous plasma is introduced."
    assert got[1000].text == "should verify that the battery door has been aligned at the bedside."
    assert "lint-free cloth" in got[1002].text
    assert repaired(spark.createDataFrame([], SCHEMA), "pid", "doc").count() == 0


def test_editor_on_held_out_words():
    counts = {w.strip(".,").lower(): 500 + i for i, s in enumerate(SENTENCES) for w in s.split()}
    e = Editor(counts).train(["zorvath", "h2o2"])
    held = {"lab0ratory": "laboratory", "tbe": "the", "thc": "the", "pr!nter": "printer", "sarnple": "sample", "vvas": "was", "p1asma": "plasma"}
    assert sum(e.word(k) == v for k, v in held.items()) >= 6
    assert all(e.word(w) == w for w in [*counts, "zorvath", "quibbl"])
    assert e.joins("bat", "tery") and not e.joins("lint", "free")
    longer = Editor(counts | {"point-of-care": 700, "point": 300}).train([])
    assert not longer.joins("point", "of-care") and not longer.joins("po!nt", "of-care")  # misread halves of a compound


def test_channel_is_learned_from_the_corpus():
    words = ["kestrel", "kettle", "skipper", "market", "basket", "blanket", "monkey", "rocket", "ticket", "token", "awake", "broken", "spoken", "marker"]
    common = {w: 900 for w in words}
    rare = {w.replace("k", "#", 1): 1 for w in words} | {w + "s": 2 for w in words} | {"quibble": 1, "zorvath": 2}
    channel = learned_channel(common, rare)
    assert channel == {"#": ["k"]}
    held = {"tric#le": "trickle", "stro#e": "stroke", "pic#le": "pickle"}  # a confusion outside the fixed table, in words not seen before
    e = Editor(common | {w: 800 for w in held.values()}, channel).train(["zorvath", "quibble"])
    assert {x: e.word(x) for x in held} == held and all(e.word(w) == w for w in [*common, "zorvath", "quibble"])
    assert learned_channel({}, rare) == {} and learned_channel(common, {}) == {}


def test_every_rare_word_teaches_the_channel(spark):
    words = ["kestrel", "skipper", "market", "basket"]
    noise = [f"qq{i}x" for i in range(60_000)]
    texts = [" ".join([*words, "rocket"] * 60) for _ in range(50)] + [" ".join(noise[i: i + 2000]) for i in range(0, 60_000, 2000)] + [" ".join(w.replace("k", "#", 1) for w in words), "one more roc#et here"]
    df = spark.createDataFrame([(i, i, t, 1, None) for i, t in enumerate(texts)], SCHEMA)
    assert {r.pid: r.text for r in repaired(df, "pid", "doc").collect()}[len(texts) - 1] == "one more rocket here"


def test_channel_against_the_plain_form(spark):
    rnd = random.Random(3)
    common = {"".join(rnd.choice("abcdef") for _ in range(rnd.randrange(1, 9))): rnd.choice([100, 900, 4000]) for _ in range(300)}
    cut = [(w, rnd.randrange(len(w)), rnd.randrange(3)) for w in common for _ in range(12)]
    rare = {w[:i] + rnd.choice(["#", "1c", "d", "fa", ""]) + w[i + n:]: rnd.choice([1, 10, 30]) for w, i, n in cut}
    rare = {w: n for w, n in rare.items() if len(w) > 3}
    rare = {w: n for w, n in rare.items() if w not in common}
    df = spark.createDataFrame([*common.items(), *rare.items()], "w string, n long")
    want = learned_channel(common, rare)
    assert want and {k: sorted(v) for k, v in scans.corpus_channel(df, 100).items()} == {k: sorted(v) for k, v in want.items()}


def test_counted_examples_weigh_as_often_as_they_occur():
    ex = [([["a", "x"], ["b"]], 1), ([["a"], ["b", "x"]], 0), ([["c"], ["a"]], 0)]
    assert Perceptron().fit(ex, times=[1, 1, 1]).w == Perceptron().fit(ex).w
    m = Perceptron().fit([([[], ["h"]], 1), ([[], ["h"]], 0)], times=[1000, 3])
    assert m.score(["h"]) > 0 > Perceptron().fit([([[], ["h"]], 1), ([[], ["h", "i"]], 0)], times=[3, 1000]).score(["h", "i"])


def test_long_words_are_searched_to_their_end():
    long = "electroencephalographically-microspectrophotometrically"
    e = Editor({long: 500, "the": 900}, {})
    damaged = long[:30] + long[30:].replace("l", "1", 2)
    assert e.candidates(damaged)[long] == ("1>l", "1>l")


def test_perceptron_learns():
    m = Perceptron().fit([([["a"], ["b"]], 1), ([["c"], ["d"]], 0)] * 5)
    assert m.score(["b"]) > m.score(["a"]) and m.score(["c"]) >= m.score(["d"])


def test_budget_is_hit_exactly():
    rnd = random.Random(9)
    for _ in range(150):
        h = {rnd.randrange(1, 60): rnd.randrange(1, 9) for _ in range(rnd.randrange(1, 9))}
        most = rnd.randrange(1, 4)
        whole = sum(n * c for n, c in h.items()) * most
        budget = rnd.randrange(0, whole + 5)
        sums = {0}
        for n, c in h.items():
            sums = {s + n * k for s in sums for k in range(c * most + 1)}
        got = fit_budget(h, budget, most)
        total = sum(n * c for n, c in got.items())
        assert all(c <= h[n] * most for n, c in got.items()) and total <= budget
        if max(h) * 4 >= min(budget, whole - budget):
            assert total == max(s for s in sums if s <= budget)
    assert fit_budget({}, 5) == {} and fit_budget({3: 2}, 0) == {}
    big = {3_000_000: 5, 2_000_001: 4, 900: 50, 7: 300}
    got = fit_budget(big, 11_000_123)
    assert 8_000_123 <= sum(n * c for n, c in got.items()) <= 11_000_123 and all(c <= big[n] for n, c in got.items())


def test_subset_sum_reads_back_its_choice():
    rnd = random.Random(4)
    for _ in range(200):
        sizes = {rnd.randrange(1, 40): rnd.randrange(1, 12) for _ in range(5)}
        target = rnd.randrange(1, 300)
        got = subset_sum(sizes, target)
        assert all(k <= sizes[n] for n, k in got.items())
        over = subset_sum(sizes, target, at_least=True)
        assert all(k <= sizes[n] for n, k in over.items())
        sums = {0}
        for n, c in sizes.items():
            sums = {s + n * k for s in sums for k in range(c + 1)}
        assert sum(n * k for n, k in got.items()) == max(s for s in sums if s <= target)
        assert sum(n * k for n, k in over.items()) == min((s for s in sums if s >= target), default=max(sums))


def test_plan_reports_short_and_absent_sources():
    plans = {p["source"]: p for p in plan_mixture({"a": {10: 10}, "b": {5: 2}}, {"a": (0.5, 2), "b": (0.4, 3), "c": (0.1, 9)}, total=200)}
    assert plans["c"]["budget"] == 0 and plans["b"]["uses"] == {5: 6} and plans["a"]["budget"] == 111 and plans["a"]["uses"] == {10: 11}


def test_mixture(spark):
    rows = [(i, " A " if i % 2 else "b", "word " * (i % 17 + 1)) for i in range(300)] + [(900, "a", None), (901, None, "x"), (902, "z", "other"), (903, "a", "long " * 20_000)]
    docs = spark.createDataFrame(rows * 2, "doc_id int, source string, text string").selectExpr("*", "1 AS copies", "2 AS tokens")
    targets = spark.createDataFrame([("a", 0.7, 1), ("B", 0.25, 3), ("gone", 0.05, 2), (None, 0.1, 1)], "source string, target_share double, max_repeats int")
    args = {"vocabulary": "/opt/tokenizers/byte_bpe_50k.tiktoken", "pattern": r" ?\p{L}+|\s+"}
    chosen, shares = mixture(docs, targets, **args)
    got = chosen.collect()
    limit = {"a": 1, "b": 3}
    assert got and all(1 <= r.copies <= limit[r.source] for r in got) and len({r.doc_id for r in got}) == len(got)
    s = {r.source: r for r in shares.collect()}
    assert s["gone"].status == "no documents" and s["b"].mixed_tokens <= s["b"].budget
    assert abs(sum(r.actual_share for r in s.values()) - 1) < 1e-5
    assert mixture(spark.createDataFrame([], docs.schema), targets, **args)[0].count() == 0
    assert mixture(docs, spark.createDataFrame([], targets.schema), **args)[0].count() == 0
