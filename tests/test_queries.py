"""Every query with SQL gives the rows of its SQL; the others are held to plain Python."""

import duckdb
import numpy as np
import pandas as pd
import pytest

from docweave.operators import numeric
from docweave.plans import registry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect(config={"memory_limit": "4GB"})
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def text(x):
    if isinstance(x, (list, tuple, np.ndarray)):
        return "[" + ",".join(map(text, x)) + "]"
    if x is None or x is pd.NaT or x is pd.NA or (isinstance(x, float) and x != x):
        return "NULL"
    return repr(round(float(x), 6) + 0.0) if isinstance(x, (float, np.floating)) else str(x)


def table(df):
    columns = sorted(df.columns)
    return df[columns].map(text).sort_values(columns).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_matches_sql(spark, con, name):
    got, want = registry.QUERIES[name](spark, DATA).toPandas(), con.sql(registry.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    pd.testing.assert_frame_equal(table(got), table(want), check_dtype=False)


def test_limiter_batch_and_stream_agree_with_a_fold(spark):
    events = spark.read.parquet(f"{DATA}/events.parquet").select("user_id", "event_id", "ts").toPandas().sort_values(["ts", "event_id"])
    kept, want = {}, {}
    for r in events.itertuples():
        now = r.ts.value / 1e9
        mine = kept.setdefault(r.user_id, [])
        mine[:] = [t for t in mine if t > now - 3600]
        want[r.event_id] = len(mine) < 3
        if want[r.event_id]:
            mine.append(now)
    for name in ("rate_limited", "stream_rate_limiter"):
        got = {r.event_id: r.allowed for r in registry.QUERIES[name](spark, DATA).collect()}
        assert got == want, name


def test_minhash_estimates_similarity(spark):
    found = registry.QUERIES["minhash_candidates"](spark, DATA).toPandas()
    assert (found.a < found.b).all() and found.similarity.between(0, 1).all()


def test_marginal_relevance_starts_with_the_best(spark):
    picks = registry.QUERIES["marginal_relevance"](spark, DATA).toPandas().sort_values("pick")
    best = registry.QUERIES["cosine_topk"](spark, DATA).toPandas().sort_values(["score", "item_id"], ascending=[False, True])
    assert picks.item_id.iloc[0] == best.item_id.iloc[0] and picks.item_id.is_unique and len(picks) == 10


def test_knapsack_against_all_subsets():
    rng = np.random.RandomState(3)
    for _ in range(30):
        n, budget = rng.randint(1, 9), int(rng.randint(1, 40))
        value, size = rng.randint(1, 20, n).astype(float), rng.randint(1, 20, n)
        sums = [(value[list(c)].sum(), size[list(c)].sum()) for m in range(2**n) for c in [[i for i in range(n) if m >> i & 1]]]
        best = max(v for v, s in sums if s <= budget)
        exact, greedy = numeric.exact_knapsack(value, size, budget), numeric.greedy_knapsack(value, size, budget)
        assert value[exact].sum() == best and size[exact].sum() <= budget
        assert size[greedy].sum() <= budget and value[greedy].sum() >= best / 2


def test_knapsacks_stay_within_budget(spark):
    for name in ("knapsack_greedy", "knapsack_exact"):
        assert registry.QUERIES[name](spark, DATA).count() > 0


def test_spectrum_starts_at_zero(spark):
    found = registry.QUERIES["laplacian_spectrum"](spark, DATA).toPandas()
    assert (found[found.i == 0].eigenvalue.abs() < 1e-6).all() and (found.eigenvalue > -1e-6).all()


def test_entry_runs_and_names_are_unique(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_chunks_cover_all_elements_within_budget(spark):
    found = registry.QUERIES["element_chunks"](spark, DATA).toPandas().sort_values(["doc_id", "chunk"])
    for _, g in found.groupby("doc_id"):
        assert g["first"].iloc[0] == 0 and (g["first"].to_numpy()[1:] == g["last"].to_numpy()[:-1] + 1).all()
        assert ((g.tokens <= 400) | (g["first"] == g["last"])).all()


def test_sentence_ranks_sum_to_at_most_one(spark):
    found = registry.QUERIES["sentence_ranks"](spark, DATA).toPandas()
    total = found.groupby("doc_id").score.sum()
    assert (found.score > 0).all() and (total <= 1 + 1e-9).all()


def test_singular_values_match_numpy(spark):
    x = np.stack(spark.read.parquet(f"{DATA}/embeddings.parquet").toPandas().embedding).astype(float)
    got = registry.QUERIES["singular_values"](spark, DATA).toPandas().sort_values("i").value
    assert np.allclose(got, np.linalg.svd(x, compute_uv=False)[:10], rtol=1e-6)


def test_cache_against_a_list(spark):
    events = spark.read.parquet(f"{DATA}/events.parquet").toPandas().sort_values(["ts", "event_id"])
    want = {}
    for user, g in events.groupby("user_id"):
        cache, hits = [], 0
        for x in g.event_type:
            hits += x in cache
            cache = ([y for y in cache if y != x] + [x])[-2:]
        want[user] = (len(g), hits)
    assert {r.user_id: (r.accesses, r.hits) for r in registry.QUERIES["cache_hit_rates"](spark, DATA).collect()} == want


def test_p_values_and_stationary_shares(spark):
    p = registry.QUERIES["experiment_p_values"](spark, DATA).toPandas()
    assert p.p.between(0, 1).all() and ((p.t.abs() > 1.96) == (p.p < 0.05)).all()
    s = registry.QUERIES["stationary_events"](spark, DATA).toPandas()
    assert s.share.sum() == pytest.approx(1)


def test_loops_and_clusters(spark):
    b = registry.QUERIES["page_loops"](spark, DATA).toPandas()
    assert (b.loops == b.edges - b.vertices + b.parts).all() and (b.loops >= 0).all() and (b.parts >= 1).all()
    c = registry.QUERIES["embedding_clusters"](spark, DATA).toPandas()
    assert c.node.is_unique and (c.component <= c.node).all() and len(c) == spark.read.parquet(f"{DATA}/embeddings.parquet").count()


def roots_of(ids, pairs):
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        up[b] = a
    return {i: find(i) for i in ids}


def test_clusters_against_all_pairs(spark, monkeypatch):
    """Across labels and blocks."""
    from docweave.operators import analysis, graphs

    e = spark.read.parquet(f"{DATA}/embeddings.parquet").toPandas()
    x = np.stack(e.embedding).astype(float)
    x /= np.sqrt((x * x).sum(1))[:, None]
    a, b = np.nonzero(np.triu(x @ x.T >= 0.3, 1))
    assert (e.label.to_numpy()[a] != e.label.to_numpy()[b]).any()
    want = roots_of(e.vec_id.tolist(), zip(e.vec_id[a].tolist(), e.vec_id[b].tolist()))
    assert {r.node: r.component for r in registry.QUERIES["embedding_clusters"](spark, DATA).collect()} == want
    monkeypatch.setattr(analysis, "BLOCK", 40)
    rows = [(i, [1.0, 0.0]) for i in range(100)] + [(100 + i, [0.0, 1.0 + i]) for i in range(100)] + [(300, [0.0, 0.0]), (301, [0.0, 0.0]), (302, None), (303, [float("nan"), 1.0]), (304, [1.0, None]), (305, [1.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "k long, v array<double>")
    links = analysis.cosine_links(df, "k", "v", 0.9).unionByName(df.selectExpr("k AS src", "k AS dst"))
    assert {r.node: r.component for r in graphs.components(links).collect()} == {i: i // 100 * 100 if i < 200 else i for i, _ in rows}
    assert analysis.cosine_links(df.limit(0), "k", "v", 0.9).count() == 0


def test_minhash_pairs_all_members_of_a_band(spark, tmp_path):
    rng = np.random.RandomState(6)
    base = [f"w{i}" for i in range(60)]
    texts = {i: " ".join([*base, *(f"x{i}y{j}" for j in range(3))]) for i in range(6)}  # near copies of one another
    texts |= {10 + i: texts[3] for i in range(3)} | {20 + i: " ".join(f"z{k}" for k in rng.randint(0, 10**6, 40)) for i in range(5)}
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    found = registry.QUERIES["minhash_candidates"](spark, str(tmp_path)).toPandas()
    assert set(zip(found.a[~found.member], found.b[~found.member])) == {(i, j) for i in range(6) for j in range(i + 1, 6)}
    assert set(zip(found.a[found.member], found.b[found.member])) == {(3, 10), (3, 11), (3, 12)}
    assert ((found.similarity * 128) % 1 == 0).all() and (found.similarity > 0.7).all()


def test_signed_ranks_beyond_a_long(spark):
    """n (n + 1) (2 n + 1) leaves a long at two million rows."""
    from docweave.operators.analysis import signed_ranks

    n = 2_000_000
    r = signed_ranks(spark.range(n).selectExpr("CAST(id % 2 AS DOUBLE) AS a", "0.5D AS b"), "a", "b").first()
    assert r.n == n and r.w_plus == r.w_minus == n / 2 * (n + 1) / 2 and r.z == 0
    r = signed_ranks(spark.range(n).selectExpr("1.0D AS a", "0.0D AS b"), "a", "b").first()
    assert r.z == pytest.approx(n * (n + 1) / 4 / (n * (n + 1) * (2 * n + 1) / 24) ** 0.5)


def test_spectrum_counts_leaves(spark):
    """Against the whole matrix, on trees, pairs, and graphs with cycles and leaves; stars of 100,000 leaves are not held by a task."""
    r = np.random.RandomState(3)
    rows = [("pair", "x", "y", 2.0), ("star", "h", "a", 1.0), ("star", "h", "b", 1.0), ("star", "h", "c", 3.0), ("loop", "p", "p", 1.0), ("loop", "p", "q", 1.0)]
    rows += [("cycle", f"c{i}", f"c{(i + 1) % 6}", 1.0 + i) for i in range(6)] + [("cycle", f"c{r.randint(6)}", f"l{i}", float(r.randint(1, 3))) for i in range(25)]
    got = {}
    for x in numeric.spectrum(spark.createDataFrame(rows, "g string, src string, dst string, weight double"), "g", 30).collect():
        got.setdefault(x.g, {})[x.i] = x.eigenvalue
    for g in ("pair", "star", "loop", "cycle"):
        names = sorted({n for h, s, t, _ in rows if h == g for n in (s, t)})
        m = np.zeros((len(names), len(names)))
        for h, s, t, w in rows:
            if h == g and s != t:
                i, j = names.index(s), names.index(t)
                m[i, j] = m[j, i] = -w
        np.fill_diagonal(m, -m.sum(0))
        want = np.linalg.eigvalsh(m)[:30]
        assert [got[g][i] for i in range(len(got[g]))] == pytest.approx(want.tolist(), abs=1e-8)
    wide = spark.range(100_000).selectExpr("'w' AS g", "'h' AS src", "CAST(id AS STRING) AS dst", "1.0D AS weight")
    assert [round(x.eigenvalue, 6) for x in numeric.spectrum(wide, "g", 4).orderBy("i").collect()] == [0, 1, 1, 1]


def test_near_lists_hold_the_nearest_exactly(spark, monkeypatch):
    from docweave.operators import retrieval

    monkeypatch.setattr(retrieval, "HELD", 64)
    r = np.random.RandomState(5)
    x = r.randn(200, 6)
    x[50:60] = x[0]
    v = spark.createDataFrame([(i, [float(y) for y in row]) for i, row in enumerate(x)], "item_id long, v array<double>")
    c = v.where("item_id % 10 = 0").selectExpr("item_id AS list", "v AS cv")
    found = {}
    for row in retrieval.near_lists(v, c).collect():
        found.setdefault(row.item_id, []).append((round(row.dist, 9), row.list))
    want = {i: min((round(float(np.sqrt(((a - x[j]) ** 2).sum())), 9), j) for j in range(0, 200, 10)) for i, a in enumerate(x)}
    assert {i: min(p) for i, p in found.items()} == want
    assert sum(map(len, found.values())) < 250


def test_near_cosines_hold_the_nearest_exactly(spark, monkeypatch):
    from docweave.operators import retrieval

    monkeypatch.setattr(retrieval, "HELD", 64)
    r = np.random.RandomState(6)
    x = r.randn(120, 5)
    x[50:60], x[70] = x[0], 0
    v = spark.createDataFrame([(i, [float(y) for y in row]) for i, row in enumerate(x)], "item_id long, v array<double>")
    found = {}
    for row in retrieval.near_cosines(v, v.where("item_id % 10 = 0").selectExpr("item_id AS qid", "v AS qv"), 5).collect():
        found.setdefault(row.qid, []).append((-round(row.score, 9) + 0.0, row.item_id))
    n = np.linalg.norm(x, axis=1)
    cosine = lambda a, b: float(x[a] @ x[b] / (n[a] * n[b])) if n[a] * n[b] > 0 else 0.0
    assert {q: sorted(p)[:5] for q, p in found.items()} == {q: sorted((-round(cosine(q, j), 9) + 0.0, j) for j in range(120) if j != q)[:5] for q in range(0, 120, 10)}
