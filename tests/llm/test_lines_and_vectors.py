"""Whitening, line dedup and sort-means against brute force: nulls, empties, ties, repeats, clashing columns, empty tables."""

import hashlib
import random
import re
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from docweave.llm import line_dedup, queries, sort_means, whitening
from docweave.llm.cuckoo import Filter
from docweave.llm.line_dedup import LineIndex

SF = "/root/testdata/sf0.001"
NAN, INF = float("nan"), float("inf")
VECTORS = "vec_id long, embedding array<double>, component int, cluster int, x string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 7, 7, "x") for i, v in rows], VECTORS).repartition(3)


# --- 11 whitening


def exact_covariance(x):
    """As fractions: numpy only for the eigenvectors."""
    distinct = sorted({tuple(r) for r in x})
    n, size = len(distinct), len(distinct[0])
    sums = [sum(r[i] for r in distinct) for i in range(size)]
    mean = [Fraction(s, n) for s in sums]
    c = [[r[i] - mean[i] for i in range(size)] for r in distinct]
    return n, sums, np.array([[float(sum(r[i] * r[j] for r in c) / n) for j in range(size)] for i in range(size)])


@pytest.mark.parametrize("offset", [0, 3_000_000])
def test_whitening_equals_exact_fractions(spark, offset):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((150, 6)) @ np.diag([5, 3, 2, 1, 0.5, 0.2]) + offset
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(base)]
    rows += [(200 + i, rows[0][1]) for i in range(40)]  # copies weigh nothing
    rows += [(None, rows[1][1]), (3, rows[2][1])]
    bad = [(300, None), (301, [1.0] * 5 + [None]), (302, [1.0] * 5 + [NAN]), (303, [INF] + [0.0] * 5), (304, []), (305, [1.0]), (306, [1e300] + [0.0] * 5)]
    got = whitening.whiten(vectors(spark, rows + bad)).collect()
    x = [[int(np.floor(256 * c)) for c in v] for _, v in rows]
    n, sums, covariance = exact_covariance(x)
    values, directions = np.linalg.eigh(covariance)
    values, directions = values[::-1][:4], directions[:, ::-1][:, :4]
    assert len(got) == 4 * len(rows) and {r.n for r in got} == {n}
    by_row = {}
    for r in got:
        by_row.setdefault(r.vec_id, {}).setdefault(r.component, []).append(r)
    for (i, _), own in zip(rows, x):
        deviation = sum((n * c - s) ** 2 for c, s in zip(own, sums))
        for k in range(4):
            want = float(sum(float(c - Fraction(s, n)) * u for c, s, u in zip(own, sums, directions[:, k])) / np.sqrt(values[k]))
            held = by_row[i][k + 1]
            assert any(int(r.deviation) == deviation and abs(abs(r.whitened) - abs(want)) < 1e-9 * max(1, abs(want)) for r in held)
            assert abs(held[0].explained / (values[k] / np.trace(covariance)) - 1) < 1e-9
    assert {r.identity_error for r in got if r.identity_error > 1e-9} == set()
    signs = {np.sign(r.whitened * float(sum(float(c - Fraction(s, n)) * u for c, s, u in zip(own, sums, directions[:, r.component - 1])))) for (i, _), own in zip(rows[:50], x) for r in got if r.vec_id == i and r.component == 1 and abs(r.whitened) > 1e-6 and i not in (3,)}
    assert len(signs) == 1  # one sign for all rows


def test_whitening_without_rows_or_variance(spark):
    assert whitening.whiten(vectors(spark, [])).count() == 0
    assert whitening.whiten(vectors(spark, [(1, None), (2, [])])).count() == 0
    alone = whitening.whiten(vectors(spark, [(1, [0.5, 1.0]), (2, [0.5, 1.0])])).collect()
    assert sorted((r.vec_id, r.component, r.n, int(r.deviation), r.whitened, r.explained, r.identity_error) for r in alone) == [(i, k, 1, 0, 0.0, 0.0, 0.0) for i in (1, 2) for k in (1, 2)]
    line = whitening.whiten(vectors(spark, [(1, [0.0, 2.0]), (2, [1.0, 2.0])])).collect()  # the second dimension is constant
    assert sorted((r.vec_id, r.component, abs(r.whitened), r.explained) for r in line) == [(1, 1, 1.0, 1.0), (1, 2, 0.0, 0.0), (2, 1, 1.0, 1.0), (2, 2, 0.0, 0.0)]


def test_deviations_are_exact_beyond_machine_numbers(spark):
    x = np.array([[2**40, -(2**40)], [3, 4]], dtype=np.int64)
    sums = [2**40 + 3, 4 - 2**40]
    assert whitening.deviations(x, 2, sums) == [sum((2 * int(c) - s) ** 2 for c, s in zip(r, sums)) for r in x]
    rows = [(1, [2.0**40, 1.0]), (2, [0.0, 1.0]), (3, [2.0**53, 1.0])]
    got = {r.vec_id: int(r.deviation) for r in whitening.whiten(vectors(spark, rows)).collect()}
    n, own = 3, {i: [int(256 * c) for c in v] for i, v in rows}
    sums = [sum(v[k] for v in own.values()) for k in range(2)]
    assert got == {i: sum((n * c - s) ** 2 for c, s in zip(v, sums)) for i, v in own.items()}
    small = queries.op11_whitening(spark, SF)
    assert dict(small.dtypes)["deviation"] == "bigint" and small.where("deviation IS NULL").isEmpty()


def test_outer_products_hold_what_doubles_lose():
    rng = np.random.default_rng(5)
    high = rng.standard_normal((700, 3)) * np.array([1e9, 1.0, 1e-9])
    low = high * 2.0**-54 * rng.uniform(-1, 1, high.shape)
    total = whitening.OuterProducts(3)
    for i in range(0, 700, 128):
        total.update(high[i : i + 128], low[i : i + 128])
    exact = [[sum((Fraction(h[i]) + Fraction(m[i])) * (Fraction(h[j]) + Fraction(m[j])) for h, m in zip(high, low)) for j in range(3)] for i in range(3)]
    top = np.abs(high).max(axis=0)
    for i in range(3):
        for j in range(3):
            off = abs(Fraction(total.high[i, j]) + Fraction(total.low[i, j]) - exact[i][j])
            assert off <= Fraction(top[i]) * Fraction(top[j]) * 700 * Fraction(1, 2**80)  # doubles give 2**-53
    a, b = rng.standard_normal(1000) * 1e8, rng.standard_normal(1000)
    s, e = whitening.two_sum(a, b)
    assert all(Fraction(x) + Fraction(y) == Fraction(u) + Fraction(v) for x, y, u, v in zip(a, b, s, e))


# --- 12 line dedup


def brute_lines(docs, least=10):
    strip = re.compile(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$")
    key = lambda line: re.sub("[A-Z]", lambda m: m[0].lower(), strip.sub("", line))
    first = {}
    for i, text in docs:
        for line in (text or "").split("\n"):
            if i is not None and len(key(line)) >= least:
                first[key(line)] = min(first.get(key(line), i), i)
    out = []
    for i, text in docs:
        lines = (text or "").split("\n")
        kept = [s for s in lines if i is None or len(key(s)) < least or i <= first[key(s)]]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def some_documents(seed, ids):
    rng = random.Random(seed)
    pool = ["Shared line number %d" % i for i in range(25)] + ["short", "", "  ", "\x1cédge é à ü 10", "Ä" * 9, "Ä" * 10, "ÄB" * 5, "äB" * 5, "x " * 5, "tab\tinside here"]
    vary = [str, str.upper, lambda s: "  " + s, lambda s: s + "\r", lambda s: "\x0b" + s + "\t "]
    return [(i, "\n".join(rng.choice(vary)(rng.choice(pool)) if rng.random() < 0.7 else f"only {i} {rng.random()}" for _ in range(rng.randint(1, 9)))) for i in ids]


def held(df):
    return sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept) for r in df.collect()), key=str)


def as_docs(spark, docs):
    return spark.createDataFrame([(i, t, 5, 6) for i, t in docs], "doc_id long, text string, n_lines int, key int").repartition(3)


def test_line_dedup_equals_brute_force(spark):
    docs = some_documents(1, range(60))
    docs += [(100, None), (101, ""), (102, "\n\n"), (None, docs[0][1]), (None, None), (5, docs[9][1]), (5, docs[9][1]), (-3, docs[20][1]), (103, "the same line again\n" * 3000), (104, "The Same Line Again  ")]
    out = line_dedup.dedup_lines(as_docs(spark, docs))
    assert held(out) == brute_lines(docs)
    assert out.columns == ["doc_id", "key", "n_lines", "n_dropped", "kept"]
    assert line_dedup.dedup_lines(as_docs(spark, [])).count() == 0
    assert held(line_dedup.dedup_lines(as_docs(spark, docs[:7]), least=1)) == brute_lines(docs[:7], 1)


def test_line_index_grows_and_forgets(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "FOLD", 3)
    first, second, third = some_documents(2, range(0, 40)), some_documents(3, range(40, 70)), some_documents(4, range(-20, 0))
    index = LineIndex(spark)
    index.insert(as_docs(spark, first))

    def state():
        filters = {r.shard: Filter.from_bytes(bytes(r["filter"])) for r in index.filters.collect()}
        return (
            sorted((bytes(r.key), r.doc_id, r.lines) for r in index.references().collect()),
            sorted((bytes(r.key), r.lines, r.least) for r in index.counts.collect()),
            sorted((s, len(f), sorted(f.table[f.table > 0].tolist())) for s, f in filters.items() if len(f)),
        )

    start = state()
    index.insert(as_docs(spark, second))
    index.insert(as_docs(spark, third))
    assert held(index.dedup(as_docs(spark, first + second + third))) == brute_lines(first + second + third)
    index.delete(spark.createDataFrame([(i,) for i in [*range(40, 70), 999, None]], "doc_id long"))
    assert held(index.dedup(as_docs(spark, first + third))) == brute_lines(first + third)
    index.delete(spark.createDataFrame([(i,) for i in range(-20, 0)], "doc_id long"))
    assert state() == start  # references, counts and every fingerprint
    assert held(index.dedup(as_docs(spark, first))) == brute_lines(first)
    again = LineIndex(spark)
    again.insert(as_docs(spark, first))
    assert state()[:2] == (start[0], start[1]) and sorted((bytes(r.key), r.lines, r.least) for r in again.counts.collect()) == start[1]
    index.delete(spark.createDataFrame([(i,) for i in range(0, 40)], "doc_id long"))
    assert index.counts.isEmpty() and index.references().isEmpty()
    index.insert(as_docs(spark, second))  # a forgotten document comes back
    assert held(index.dedup(as_docs(spark, second))) == brute_lines(second)


def test_line_dedup_without_filters_and_with_hot_keys(spark, monkeypatch):
    docs = some_documents(6, range(50))
    index = LineIndex(spark)
    index.insert(as_docs(spark, docs))
    n_refs, met = index.references().count(), index.candidates(index.references()).count()
    recurring = index.references().join(index.counts, "key", "left_semi").count()
    assert recurring <= met < n_refs and met - recurring <= 2  # filters lose none and let few others pass
    monkeypatch.setattr(line_dedup, "MAX_FILTER_BYTES", 10)
    assert index.candidates(index.references()).count() == n_refs
    assert held(index.dedup(as_docs(spark, docs))) == brute_lines(docs)
    # shards that overflow are doubled
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", 2)
    monkeypatch.setattr(line_dedup, "SHARDS", 1)
    monkeypatch.setattr(line_dedup, "MAX_FILTER_BYTES", 48 << 20)
    small = LineIndex(spark)
    small.insert(as_docs(spark, docs[:5]))
    small.insert(as_docs(spark, docs[5:]))
    assert small.shards >= 8 and held(small.dedup(as_docs(spark, docs))) == brute_lines(docs)


def test_cuckoo_filter_holds_and_forgets():
    rng = np.random.default_rng(1)
    high, low = (rng.integers(0, 2**63, 40_000, dtype=np.int64).astype(np.uint64) for _ in range(2))
    f = Filter(20_000)
    f.insert(high[:15_000], low[:15_000])
    f.insert(high[15_000:20_000], low[15_000:20_000])
    assert f.contains(high[:20_000], low[:20_000]).all() and len(f) == 20_000
    assert f.contains(high[20_000:], low[20_000:]).mean() < 1 / 2000
    f = Filter.from_bytes(f.to_bytes())
    f.delete(high[:9_000], low[:9_000])
    assert f.contains(high[9_000:20_000], low[9_000:20_000]).all() and f.contains(high[:9_000], low[:9_000]).mean() < 1 / 1000
    f.delete(high[9_000:20_000], low[9_000:20_000])
    assert len(f) == 0 and not f.table.any() and not f.aside
    tight = Filter(4)  # equal fingerprints and buckets: what finds no place is kept aside
    same = np.zeros(30, dtype=np.uint64)
    tight.insert(same, same)
    assert tight.full and tight.aside and tight.contains(same, same).all()
    tight = Filter.from_bytes(tight.to_bytes())
    tight.delete(same, same)
    assert len(tight) == 0 and not tight.aside and not tight.contains(same, same).any()


# --- 13 sort-means


def brute_means(rows, k, rounds, scale, seed, size):
    keep = [(i, [int(np.floor(scale * c)) for c in v]) for i, v in rows if v is not None and len(v) == size and all(c is not None and np.isfinite(c) for c in v)]
    mark = lambda i: hashlib.sha256(f"{seed}:{'null' if i is None else i}".encode()).hexdigest()
    centroids = [x for _, x in sorted(((mark(i), x) for i, x in keep))[:k]]
    measure = lambda x, c: sum((a - b) ** 2 for a, b in zip(x, c))
    nearest = lambda x: min((measure(x, c), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        at = [nearest(x)[1] for _, x in keep]
        for j in set(at):
            own = [x for (_, x), a in zip(keep, at) if a == j]
            centroids[j] = [sum(c) // len(own) for c in zip(*own)]
    last = [(i, *nearest(x)[::-1]) for i, x in keep]
    sums = [sum(d for _, j, d in last if j == c) for c in range(len(centroids))]
    return sorted(((i, j, d, sums[j], sum(sums), sort_means.digest(centroids[j])) for i, j, d in last), key=str)


@pytest.mark.parametrize("wide", [1.0, 2.0**33])
def test_sort_means_equals_brute_force(spark, wide):
    rng = random.Random(8)
    rows = [(i, [rng.choice([-1.0, -0.5, 0.0, 0.25, 1.0]) * wide for _ in range(4)]) for i in range(120)]  # many ties
    rows += [(3, rows[3][1]), (3, rows[4][1]), (None, rows[5][1]), (None, [0.0] * 4)] + [(500 + i, [0.25 * wide] * 4) for i in range(60)]
    rows += [(700, None), (701, [1.0] * 3), (702, [NAN, 0.0, 0.0, 0.0]), (703, [None, 0.0, 0.0, 0.0]), (704, [INF, 0.0, 0.0, 0.0]), (705, [])]
    for k, rounds in ((7, 3), (1, 1)):
        got = sort_means.cluster(vectors(spark, rows), centroids=k, rounds=rounds, dimensions=4)
        held = sorted(((r.vec_id, r.cluster, int(r.distance), int(r.cluster_inertia), int(r.inertia), sort_means.digest(r.centroid)) for r in got.collect()), key=str)
        assert held == brute_means(rows, k, rounds, 64, 1, 4)


def test_sort_means_with_few_rows(spark):
    assert sort_means.cluster(vectors(spark, []), dimensions=2).count() == 0
    got = sort_means.cluster(vectors(spark, [(1, [0.0, 1.0]), (2, [0.0, 1.0]), (3, [-5.0, 0.01])]), dimensions=2).collect()
    assert sorted((r.vec_id, int(r.distance)) for r in got) == [(1, 0), (2, 0), (3, 0)]
    with pytest.raises(ValueError):
        sort_means.cluster(vectors(spark, []), centroids=sort_means.MAX_CENTROIDS + 1)


def test_sort_means_measures_few_distances():
    rng = np.random.default_rng(2)
    centroids = rng.integers(-1000, 1000, (64, 8))
    x = centroids[rng.integers(0, 64, 5000)] + rng.integers(-40, 40, (5000, 8))
    order = sort_means.Order(centroids)
    best, distance, first = order.assign(x, np.zeros(len(x), dtype=np.int64))
    all_of_them = ((x[:, None, :] - centroids) ** 2).sum(axis=2)
    assert (best == all_of_them.argmin(axis=1)).all() and (distance == all_of_them.min(axis=1)).all()
    again, _, measured = order.assign(x, best)
    assert (again == best).all() and measured < len(x) * 2 < first


def test_vector_and_line_queries_over_tables(spark):
    embeddings, documents = spark.read.parquet(f"{SF}/embeddings.parquet"), spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.vec_id, r.embedding) for r in embeddings.collect()]
    got = sorted((tuple(r) for r in queries.op13_sort_means(spark, SF).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()), key=str)
    assert got == brute_means(rows, 16, 3, 64, 1, 64)
    want = [(i, n, d, hashlib.sha256(t.encode()).hexdigest()) for i, n, d, t in brute_lines([(r.doc_id, r.text) for r in documents.collect()])]
    assert sorted((tuple(r) for r in queries.op12_line_dedup(spark, SF).select("doc_id", "n_lines", "n_dropped", "kept_sha256").collect()), key=str) == sorted(want, key=str)
    white = queries.op11_whitening(spark, SF).groupBy("component").agg(F.count("*").alias("n"), F.max("identity_error").alias("e"), F.stddev_pop("whitened").alias("s")).collect()
    assert len(white) == 4 and all(r.e < 1e-9 and abs(r.s - 1) < 0.2 for r in white)
