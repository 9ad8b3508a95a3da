"""Orphan references against brute force, with nulls, ties, repeated rows and empty sides."""

import random
from datetime import datetime, timedelta

from factloom.operators.orphans import fold_key, orphan_references, orphans_by_month

R = "target string, key string, at timestamp, source_table string, ref_field string, record_key string"
P = "target string, key string, valid_from timestamp, valid_to timestamp"
PAYLOAD = ["source_table", "ref_field", "record_key"]
T0 = datetime(2020, 1, 1)


def brute(refs, parents):
    out = set()
    for t, k, at, *p in refs:
        if k is None:
            continue
        mine = [(a, z) for pt, pk, a, z in parents if (pt, pk) == (t, k) and a is not None]
        seen = [z for a, z in mine if at is not None and a <= at]
        if any(z is None or z > at for z in seen):
            continue
        out.add((*p, t, k, at, "missing" if not mine else "deleted" if seen else "late"))
    return out


def test_random_against_brute_force(spark):
    rnd = random.Random(5)
    day = lambda: T0 + timedelta(days=rnd.randrange(200))
    refs = [("t", rnd.choice(["hot"] * 6 + list("abcdef") + [None]), rnd.choice([day(), day(), day(), None]), "s", "f", f"r{rnd.randrange(300)}") for _ in range(600)]
    parents = [("t", rnd.choice(["hot", "a", "b", "c"]), rnd.choice([day(), day(), None]), rnd.choice([None, day()])) for _ in range(40)]
    refs += refs[:50]
    parents += parents[:10]
    got = orphan_references(spark.createDataFrame(refs, R).selectExpr("*", "1 AS until", "2 AS b"), spark.createDataFrame(parents, P), PAYLOAD)
    assert {tuple(r) for r in got.collect()} == brute(refs, parents)
    assert got.count() == len(brute(refs, parents))


def test_same_instant_counts_as_loaded_and_as_ended(spark):
    at = datetime(2021, 2, 1)
    refs = [("t", "k", at, "s", "f", "1"), ("t", "z", at, "s", "f", "2")]
    parents = [("t", "k", at, None), ("t", "z", T0, at)]
    got = orphan_references(spark.createDataFrame(refs, R), spark.createDataFrame(parents, P), PAYLOAD).collect()
    assert [(r.record_key, r.status) for r in got] == [("2", "deleted")]


def test_empty_sides(spark):
    refs, none = spark.createDataFrame([("t", "k", T0, "s", "f", "1")], R), spark.createDataFrame([], P)
    assert [r.status for r in orphan_references(refs, none, PAYLOAD).collect()] == ["missing"]
    assert orphan_references(spark.createDataFrame([], R), none, PAYLOAD).count() == 0
    assert orphans_by_month(orphan_references(refs, none, PAYLOAD)).collect()[0]["period"] == "2020-01"


def test_placeholders_are_no_references(spark):
    df = spark.createDataFrame([(x,) for x in (" N/A ", "none", "-", "", "\t", "UNASSIGNED", None, " AbC ")], "k string")
    assert [r[0] for r in df.select(fold_key("k")).collect()] == [None] * 7 + ["abc"]
