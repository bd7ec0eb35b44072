"""Reading orders against plain versions, on pages with rows, ties and cycles."""

import random

from pyspark.sql import functions as F

from docweave.operators import order as O

E = "doc_id long, page int, seq long, type string, x0 double, y0 double, x1 double, y1 double"


def pages(rng, n):
    """Boxes on rows of nearly one height, so that successors run in circles."""
    out = []
    for page in range(n):
        for seq in range(rng.choice([1, 2, 5, 12])):
            x, y = rng.randrange(0, 40) / 50, rng.randrange(0, 5) * 0.02 if page % 2 else rng.randrange(0, 30) / 31
            out.append((1 + page % 3, page, seq, "text", x, y, x + rng.choice([0.02, 0.3]), y + 0.02))
    return out


def successor(a, b):
    dy = b[5] - a[5]
    return b[4] > a[4] if abs(dy) < 0.03 else dy > 0.03


def plain_edges(rows):
    gap = lambda a, b, i: max(0.0, max(a[i], b[i]) - min(a[i + 2], b[i + 2]))
    return {(a[:2], a[2], b[2]) for a in rows for b in rows if a[:2] == b[:2] and a != b and successor(a, b) and (gap(a, b, 4) ** 2 + gap(a, b, 5) ** 2) ** 0.5 <= 0.8}


def plain_order(nodes, rank, edges):
    """One node at a time, by looking at all that are left."""
    left, out = set(nodes), []
    while left:
        free = [n for n in left if not any(a in left and a != n for a, b in edges if b == n)] or left
        n = min(free, key=lambda n: (rank[n], n))
        left.remove(n)
        out.append(n)
    return out


def test_graph_and_orders_equal_plain_ones(spark):
    rows = pages(random.Random(3), 40)
    df = spark.createDataFrame(rows, E).repartition(3)
    graph = O.reading_graph(df)
    got = {((r.doc_id, r.page), r.src, r.dst) for r in graph.collect()}
    assert got == plain_edges(rows)
    order = {}
    for r in O.topological_order(df, graph, ["doc_id", "page"], "seq", ["y0", "x0"]).collect():
        order.setdefault((r.doc_id, r.page), []).append((r.position, r.seq))
    cycles = 0
    for page in {r[:2] for r in rows}:
        own = [r for r in rows if r[:2] == page]
        edges = [(a, b) for p, a, b in got if p == page]
        want = plain_order([r[2] for r in own], {r[2]: (r[5], r[4]) for r in own}, edges)
        assert [s for _, s in sorted(order[page])] == want and sorted(order[page])[0][0] == 1
        place = {s: i for i, s in enumerate(want)}
        cycles += any(place[a] > place[b] for a, b in edges)
    assert cycles > 3  # the pages do run in circles
    forward = O.acyclic(graph, O.topological_order(df, graph, ["doc_id", "page"], "seq", ["y0", "x0"]), ["doc_id", "page"], "seq")
    assert 0 < forward.count() < len(got)


def plain_levels(nodes, rank, edges):
    left, out, level = set(nodes), {}, 0
    while left:
        free = [n for n in left if not any(a in left and a != n for a, b in edges if b == n)] or [min(left, key=lambda n: (rank[n], n))]
        out.update(dict.fromkeys(free, level))
        left -= set(free)
        level += 1
    return out


def test_levels_of_graphs_with_cycles(spark):
    rng = random.Random(9)
    nodes, edges = [], []
    for g in range(6):
        n = rng.choice([1, 4, 9])
        nodes += [(g, i, float(rng.randrange(3))) for i in range(n)]
        edges += [(g, rng.randrange(n + 1), rng.randrange(n + 1)) for _ in range(2 * n)]  # loops, repeats and nodes that are not there
    nodes.append((9, 0, None))
    v, e = spark.createDataFrame(nodes, "g int, n int, p double"), spark.createDataFrame(edges, "g int, src int, dst int")
    seen = []
    got = {(r.g, r.n): r.level for r in O.topological_levels(v, e, ["g"], "n", ["p"], seen.append).collect()}
    order = {(r.g, r.n): r.position for r in O.topological_order(v, e, ["g"], "n", ["p"]).collect()}
    for g in {x[0] for x in nodes}:
        own = {n: (p or 0.0,) for h, n, p in nodes if h == g}
        inside = [(a, b) for h, a, b in edges if h == g and a in own and b in own]
        assert {n: got[(g, n)] for n in own} == plain_levels(own, own, inside)
        assert [n for n in sorted(own, key=lambda n: order[(g, n)])] == plain_order(own, own, inside)
    assert seen[0] == len(nodes) and seen == sorted(seen, reverse=True)
    assert O.topological_levels(v.limit(0), e, ["g"], "n", ["p"]).count() == 0 and O.topological_order(v.limit(0), e, ["g"], "n", ["p"]).count() == 0


def test_orders_of_nodes_by_name(spark):
    v = spark.createDataFrame([("g", "b", 1.0), ("g", "a", 2.0), (None, "c", 0.0)], "g string, n string, p double")
    e = spark.createDataFrame([("g", "a", "b"), ("g", "a", None)], "g string, src string, dst string")
    assert sorted((r.g or "", r.position, r.n) for r in O.topological_order(v, e, ["g"], "n", ["p"]).collect()) == [("", 1, "c"), ("g", 1, "a"), ("g", 2, "b")]


def test_alignment(spark):
    a = spark.createDataFrame([(1, x, i) for i, x in enumerate("abcd")] + [(2, "a", 0), (3, "a", 0), (3, "b", 1)], "g int, n string, position int")
    b = spark.createDataFrame([(1, x, i) for i, x in enumerate("badc")] + [(3, "b", 0), (4, "z", 0)], "g int, n string, position int")
    got = {r.g: r.distance for r in O.alignment(a, b, ["g"], "n").collect()}
    assert got == {1: 0.25, 2: 1.0, 3: (1 / 2 + 1) / 2, 4: 1.0}


def test_nothing_is_read_after_what_has_no_box(spark):
    df = spark.createDataFrame([(1, 1, 1, "text", 0.1, 0.1, 0.2, 0.2), (1, 1, 2, "text", None, None, None, None), (1, 1, 3, "text", 0.1, 0.5, 0.2, 0.6)], E)
    assert [(r.src, r.dst) for r in O.reading_graph(df).collect()] == [(1, 3)]
    order = O.topological_order(df, O.reading_graph(df), ["doc_id", "page"], "seq", ["y0", "x0"]).orderBy("position").select("seq").collect()
    assert [r.seq for r in order] == [2, 1, 3]
    assert O.reading_graph(df.where(F.lit(False))).count() == 0


def test_curvatures(spark):
    nodes = spark.createDataFrame([(1, "a", 0.0, 0.0), (1, "b", 3.0, 4.0), (1, "c", 0.0, 0.0), (1, "d", None, 1.0), (2, "a", 9.0, 9.0)], "g int, n string, x double, y double")
    edges = spark.createDataFrame([(1, "a", "b"), (1, "a", "c"), (1, "a", "d"), (1, "z", "a"), (2, "a", "b")], "g int, src string, dst string")
    got = {(r.g, r.src, r.dst): (r.curvature, r.is_fragile) for r in O.curvatures(edges, nodes, ["g"], "n").collect()}
    assert got == {(1, "a", "b"): (-4.0, True), (1, "a", "c"): (1.0, False), (1, "a", "d"): (0.0, False), (1, "z", "a"): (0.0, False), (2, "a", "b"): (0.0, False)}


def test_pages_are_solved_in_one_shuffle(spark):
    """Levels and forward edges of a page equal those by joins over all of them."""
    rng = random.Random(8)
    nodes = [(g, n, rng.random()) for g in ("a", "b", None) for n in range(9)]
    links = [(g, rng.randrange(10), rng.randrange(10)) for g in ("a", "b", None) for _ in range(14)]
    v, e = spark.createDataFrame(nodes, "g string, n long, p double"), spark.createDataFrame(links, "g string, src long, dst long")
    kept = "g IS NOT NULL"
    levels = {(r.g, r.n, r.level) for r in O.group_levels(v, e, ["g"], "n", ["p"]).where(kept).collect()}
    assert levels == {(r.g, r.n, r.level) for r in O.topological_levels(v.where(kept), e, ["g"], "n", ["p"]).collect()}
    order = O.topological_order(v, e, ["g"], "n", ["p"]).where(kept)
    forward = sorted((r.g, r.src, r.dst) for r in O.forward_edges(v, e, ["g"], "n", ["p"]).where(kept).collect())
    assert forward == sorted((r.g, r.src, r.dst) for r in O.acyclic(e, order, ["g"], "n").collect())
    plan = O.group_levels(v, e, ["g"], "n", ["p"])._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 1
