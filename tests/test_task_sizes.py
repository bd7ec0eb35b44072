"""Steps whose tasks grew with the table: they are more as it grows, and results stay the same."""

from collections import Counter
from itertools import combinations

import numpy as np
from pyspark.sql import functions as F

from docweave.operators import analysis as A
from docweave.operators.graphs import parts_for
from docweave.plans import corpus


def test_parts_grow_with_rows(spark):
    assert parts_for(spark, 0, 10) == 4 and parts_for(spark, 1001, 10) == 101


def test_co_members_of_large_edges_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(A, "PAIRS", 20)
    edges = {1: range(30), 2: [3, 5], 3: [7], 4: range(10, 22), None: [1, 2]}
    rows = [(e, n) for e, ns in edges.items() for n in ns] + [(2, None)]
    found = A.co_members(spark.createDataFrame(rows, "e long, n long"), "e", "n")
    want = Counter(p for e, ns in edges.items() if e is not None for p in combinations(ns, 2))
    assert {(r.a, r.b): r.shared for r in found.collect()} == want
    assert "hashpartitioning(e" in (plan := found._jdf.queryExecution().toString()) and ", share" in plan


def test_reference_edges_are_dealt_by_their_number(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(corpus, "REFERENCES", 2)
    lines = [(o, p) for o in range(8) for p in (o, o, 99)] + [(None, 1), (1, None), (77, 1)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(o,) for o in range(7)], "o_orderkey long").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(p,) for p in range(8)], "p_partkey long").write.parquet(f"{tmp_path}/part.parquet")
    found = corpus.reference_edges(spark, str(tmp_path))
    assert {(r.src, r.dst, r.mentions) for r in found.collect()} == {(f"o{o}", f"p{o}", 2) for o in range(7)}
    assert ", 13" in found._jdf.queryExecution().toString()


def test_a_strip_of_cosines_is_small():
    assert A.STRIP * A.BLOCK * 8 <= 1 << 23
    x = np.random.default_rng(2).normal(size=(300, 3))
    c = x @ x.T / np.outer(*[np.linalg.norm(x, axis=1)] * 2) >= 0.995
    reach = np.linalg.matrix_power(c.astype(float), 64) > 0
    assert (A.linked(x, None, 0.995) == reach.argmax(axis=1)).all()
