"""Recurrence by place against all pairs."""

import random
from collections import defaultdict

import pytest

from docweave.operators import recurrence as R
from docweave.plans.recurrence import placed_elements

SF = "/root/testdata/sf0.001"
ITEM = "doc long, id long, kind string, x long, y long"


def linked(items, tolerance):
    """Sets of ids: all pairs, then chains."""
    above = {i: i for _, i, *_ in items}

    def root(i):
        while above[i] != i:
            i = above[i]
        return i

    for n, (d, i, k, x, y) in enumerate(items):
        for d2, j, k2, x2, y2 in items[:n]:
            if (d, k) == (d2, k2) and abs(x - x2) < tolerance and abs(y - y2) < tolerance:
                above[root(i)] = root(j)
    out = defaultdict(set)
    for _, i, *_ in items:
        out[root(i)].add(i)
    return sorted(map(sorted, out.values()))


@pytest.mark.parametrize("seed,spread", [(1, 400), (2, 900), (3, 60)])
def test_places_equal_all_pairs(spark, seed, spread):
    rng = random.Random(seed)
    items = [(rng.randrange(2), i, rng.choice("ab"), rng.randrange(-spread, spread), rng.randrange(-spread, spread)) for i in range(220)]
    items += [(0, 900 + i, "a", 10, 10) for i in range(50)]  # one place
    # corners: exactly the tolerance apart, and one less
    items += [(5, 1000, "a", 0, 0), (5, 1001, "a", 50, 50), (6, 1002, "a", 0, 0), (6, 1003, "a", 49, 49), (7, 1004, "a", 99, 1), (7, 1005, "a", 100, -1), (8, 1006, "a", 10, 49), (8, 1007, "a", 59, 50), (8, 1008, "a", 60, 52)]
    df = spark.createDataFrame(items, ITEM).repartition(3)
    got = defaultdict(set)
    for r in R.near_places(df, ["doc", "kind"], 50).collect():
        got[(r.doc, r.kind, r.place)].add(r.id)
    assert sorted(map(sorted, got.values())) == linked(items, 50)
    assert R.near_places(df.limit(0), ["doc", "kind"], 50).count() == 0


E = "doc_id long, seq long, page int, type string, content string, x0 double, y0 double, x1 double, y1 double"


def element(seq, page, kind, content, x0=0.1, y0=0.5, w=0.4, h=0.1):
    return (1, seq, page, kind, content, x0, y0, x0 + w, y0 + h)


def found(spark, rows):
    members = R.recurrence(spark.createDataFrame(rows, E), ["doc_id"], ["seq"]).collect()
    out = defaultdict(list)
    for r in members:
        out[(r.kind, r["first"].seq)].append((r.seq, r.members, r.pages, r.is_template, r.is_dominant))
    return {k: sorted(v) for k, v in out.items()}


def test_headers_footers_and_logos(spark):
    rows = [element(i, i, "heading", "The  REPORT" if i % 2 else "the report", 0.10 + 0.02 * i, 0.02) for i in range(5)]  # a chain
    rows += [element(10, 1, "text", "The report", 0.8, 0.02)]  # elsewhere
    rows += [element(20 + i, i, "caption", "Page", 0.1, 0.9, h=0.05) for i in range(3)]
    rows += [element(30 + i, i, "figure", "", 0.01, 0.3, 0.1, 0.1) for i in range(2)] + [element(33, 3, "figure", "", 0.01, 0.3, 0.9, 0.5)]  # the last is too large
    rows += [element(40, 1, "text", None, 0.1, 0.0)]
    got = found(spark, rows)
    assert got[("header", 0)] == [(i, 5, 5, True, True) for i in range(5)]
    assert got[("header", 10)] == [(10, 1, 1, False, False)]
    assert got[("footer", 20)] == [(20 + i, 3, 3, True, False) for i in range(3)]
    assert got[("logo", 30)] == [(30, 2, 2, False, False), (31, 2, 2, False, False)]
    assert got[("header", 40)] == [(40, 1, 1, False, False)] and len(got) == 5


def test_tables_duplicates_and_what_does_not_recur(spark):
    rows = [element(i, i, "table", f"|a|b|\n|{i}|x|", 0.1 * i) for i in range(3)] + [element(3, 1, "table", "|a|b|c|\n"), element(4, 1, "table", "")]
    rows += [element(10, 1, "text", "Same words"), element(11, 4, "text", " same\nWORDS ", 0.9), element(12, 1, "text", "other words"), element(13, 1, "text", None)]
    rows += [(1, 14, 2, "text", "no box", None, None, None, None), (1, 15, 2, "text", "No box", None, None, None, None), (2, 16, 1, "text", "other words", 0.1, 0.5, 0.2, 0.6)]
    got = found(spark, rows)
    assert got == {
        ("table", 0): [(i, 3, 3, True, False) for i in range(3)],
        ("table", 3): [(3, 1, 1, False, False)],
        ("duplicate", 10): [(10, 2, 2, False, False), (11, 2, 2, False, False)],
        ("duplicate", 14): [(14, 2, 1, False, False), (15, 2, 1, False, False)],
    }
    assert found(spark, []) == {}


def test_an_element_of_two_kinds_and_marks(spark):
    rows = [element(1, 1, "text", "tall", 0.1, 0.01, h=0.95), element(2, 2, "text", "tall", 0.1, 0.01, h=0.95), element(3, 1, "text", "alone"), element(4, 1, "figure", "", 0.1, 0.95, 0.9, 0.02)]
    df = spark.createDataFrame(rows, E)
    members = R.recurrence(df, ["doc_id"], ["seq"])
    assert sorted((r.seq, r.kind) for r in members.collect()) == [(1, "footer"), (1, "header"), (2, "footer"), (2, "header"), (4, "logo")]
    marks = {r.seq: (r.kind, r.frequency, r.is_template) for r in R.marked(df, members, ["doc_id"], ["seq"]).collect()}
    assert marks == {1: ("footer", 2, False), 2: ("footer", 2, False), 3: (None, 1, False), 4: ("logo", 1, True)}


def test_tables_of_the_corpus_equal_all_pairs(spark):
    e = placed_elements(spark, SF)
    rows = [r for r in R.candidates(e).where("kind IN ('header', 'footer', 'logo')").collect()]
    items = [((r.kind, r.key), (r.doc_id, r.seq, r.kind), "", round(r.x0 * 10**6), round(r.y0 * 10**6)) for r in rows]
    got = defaultdict(set)
    for r in R.recurrence(e, [], ["doc_id", "seq"]).where("kind IN ('header', 'footer', 'logo')").collect():
        got[(r.kind, r.key, r.place)].add((r.doc_id, r.seq, r.kind))
    assert sorted(map(sorted, got.values())) == linked(items, 50_000)


def test_no_pairs_of_elements_are_made(spark):
    """A text at one place on all pages: rows per cell, not per pair."""
    df = spark.range(30_000).selectExpr("0 AS doc", "id", "'a' AS kind", "CAST(id % 7 AS long) AS x", "CAST(id % 11 AS long) AS y")
    assert R.near_places(df, ["doc", "kind"], 50).select("place").distinct().count() == 1
