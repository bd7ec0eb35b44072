"""Reading order as a topological order of a page's graph.

``reading_graph`` gives the edges in Spark.  ``topological_order`` orders each group (a page) by Kahn's algorithm with a priority queue, exactly;
``group_levels`` and ``forward_edges`` work likewise; ``topological_levels`` orders graphs of any size by rounds of joins, all ready nodes at once.  Both are defined on graphs with cycles:
where no node is ready, the first by priority of those left is taken (in each group), which breaks a cycle there.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docweave.operators.graphs import written
from docweave.operators.layout import boundary_distance, overlap, page_pairs

# fixed values: rows of a page, reach and weights of an edge
ROW, REACH = 0.03, 0.8
NEAR, ALONG, ABOVE, DECAY = 0.4, 0.4, 0.2, 0.2


def is_successor(row: float = ROW) -> Column:
    """b_ is read after a_: to the right in one row, or in a lower one."""
    dy = F.col("b_y0") - F.col("a_y0")
    return F.when(F.abs(dy) < row, F.col("b_x0") > F.col("a_x0")).otherwise(dy > row)


def reading_graph(elements: DataFrame, row: float = ROW, reach: float = REACH) -> DataFrame:
    """(doc_id, page, src, dst, weight): successors within reach; near, level and overlapping ones weigh most.

    An equi-join on the page bounds each element's partners by its page.  Elements without a box have no edges.
    """
    p = page_pairs(elements).where(is_successor(row)).withColumn("d", boundary_distance("a_", "b_")).where(F.col("d") <= reach)
    dx, dy = F.col("b_x0") - F.col("a_x0"), F.col("b_y0") - F.col("a_y0")
    length = F.sqrt(dx * dx + dy * dy)
    along = F.when(length > 0, F.greatest(F.lit(0.0), dx / length)).otherwise(1.0)
    narrow = F.greatest(F.lit(1e-4), F.least(F.col("a_x1") - F.col("a_x0"), F.col("b_x1") - F.col("b_x0")))
    above = F.least(F.lit(1.0), overlap("a_", "b_", "x") / narrow)
    weight = NEAR * F.exp(-F.col("d") / DECAY) + ALONG * along + ABOVE * above
    return p.select(F.col("a_doc_id").alias("doc_id"), F.col("a_page").alias("page"), F.col("a_seq").alias("src"), F.col("b_seq").alias("dst"), weight.alias("weight"))


def spatial_edges(elements: DataFrame, row: float = ROW) -> DataFrame:
    """(doc_id, page, src, dst): one edge at most for each pair: along a row if the centre is passed, else downwards if the boxes hardly overlap."""
    p = page_pairs(elements).where("a_seq < b_seq")
    level = F.abs(F.col("a_y0") - F.col("b_y0")) <= row
    past = lambda a, b: F.col(f"{b}x0") > F.col(f"{a}x0") + (F.col(f"{a}x1") - F.col(f"{a}x0")) / 2
    below = lambda a, b: F.col(f"{b}y0") >= F.col(f"{a}y1") - row
    forward, back = (F.when(level, past(a, b)).otherwise(below(a, b)) for a, b in (("a_", "b_"), ("b_", "a_")))
    way = F.when(forward, F.array("a_seq", "b_seq")).when(back, F.array("b_seq", "a_seq"))
    return p.withColumn("way", way).where("way IS NOT NULL").select(F.col("a_doc_id").alias("doc_id"), F.col("a_page").alias("page"), F.col("way")[0].alias("src"), F.col("way")[1].alias("dst"))


def kahn(nodes: list, priority: dict, edges: list[tuple]) -> list:
    """The order of one group."""
    after, waits = {n: [] for n in nodes}, dict.fromkeys(nodes, 0)
    for a, b in set(edges):
        if a in after and b in after and a != b:
            after[a].append(b)
            waits[b] += 1
    every = sorted(nodes, key=lambda n: (priority[n], n))
    ready = [(priority[n], n) for n in every if not waits[n]]
    heapq.heapify(ready)
    done, out, at = set(), [], 0
    while len(out) < len(nodes):
        if ready:
            n = heapq.heappop(ready)[1]
        else:
            while every[at] in done:
                at += 1
            n = every[at]
        if n in done:
            continue
        done.add(n)
        out.append(n)
        for b in after[n]:
            waits[b] -= 1
            if not waits[b] and b not in done:
                heapq.heappush(ready, (priority[b], b))
    return out


def levels_of(nodes: list, priority: dict, edges: list[tuple]) -> dict:
    """The round in which each node of one group is ready, from 0; where none is, the first by priority is taken."""
    left, out, level = set(nodes), {}, 0
    before = {n: set() for n in nodes}
    for a, b in edges:
        if a in left and b in left and a != b:
            before[b].add(a)
    while left:
        now = [n for n in left if not before[n]] or [min(left, key=lambda n: (priority[n], n))]
        for n in now:
            out[n] = level
        left.difference_update(now)
        for n in left:
            before[n].difference_update(now)
        level += 1
    return out


def by_group(nodes: DataFrame, edges: DataFrame, group: list[str], node: str, priority: list[str], solve: Callable[[list, dict, list], tuple[list, list]], out: dict[str, bool]) -> DataFrame:
    """(group, *out): ``solve`` takes a group's nodes, their priorities and edges, and gives the two columns of its rows: nodes, and nodes or
    whole numbers.  ``out``: their names, and whether they are numbers.  Nodes and edges are shuffled once, together; a group is held by one task, a batch of them at a time.
    """
    types = nodes.select(*group, node).schema
    (kind,), number = types.fields[len(group):], list(out.values())[1]
    types_out = {c: "int" if is_number else kind.dataType.simpleString() for c, is_number in out.items()}
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in types.fields[: len(group)]), *(f"`{c}` {t}" for c, t in types_out.items())])
    rank = F.struct(F.col(node).alias("node"), *(F.coalesce(F.col(p), F.lit(0.0)).cast("double").alias(f"p{i}") for i, p in enumerate(priority)))
    link = F.struct("src", "dst")
    both = nodes.select(*group, rank.alias("n")).unionByName(edges.select(*group, link.alias("e")), allowMissingColumns=True)
    held = both.groupBy(*group).agg(F.collect_list("n").alias("n"), F.collect_list("e").alias("e")).where("size(n) > 0")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            members, links = b.column(len(group)), b.column(len(group) + 1)
            at, upto = members.offsets.to_pylist(), links.offsets.to_pylist()
            first, base = at[0], upto[0]
            members, links = members.flatten(), links.flatten()
            ids, ranks = members.field("node").to_pylist(), list(zip(*(members.field(f"p{i}").to_pylist() for i in range(len(priority)))))
            pairs = list(zip(links.field("src").to_pylist(), links.field("dst").to_pylist()))
            rows, one, two = [], [], []
            for i in range(b.num_rows):
                s, e = at[i] - first, at[i + 1] - first
                place = {n: k for k, n in enumerate(ids[s:e], s)}
                x, y = solve(list(place), {n: ranks[k] for n, k in place.items()}, pairs[upto[i] - base : upto[i + 1] - base])
                rows += [i] * len(x)
                one += [place[n] for n in x]
                two += y if number else [place[n] for n in y]
            values = members.field("node")
            second = pa.array(two, pa.int32()) if number else values.take(pa.array(two, pa.int64()))
            kept = [b.column(g).take(pa.array(rows, pa.int64())) for g in range(len(group))]
            yield pa.RecordBatch.from_arrays([*kept, values.take(pa.array(one, pa.int64())), second], [*group, *out])

    return held.mapInArrow(run, schema)


def topological_order(nodes: DataFrame, edges: DataFrame, group: list[str], node: str, priority: list[str]) -> DataFrame:
    """(group, node, position): each group's nodes by Kahn's algorithm, the ready one of least (priority, node) first; from 1.

    edges: (group, src, dst); those that leave the group, repeat or lead back to their own node do not count.  A group is a page, or as
    much as one task may hold.  Null priorities count as 0.
    """

    def solve(ids: list, rank: dict, pairs: list) -> tuple[list, list]:
        return kahn(ids, rank, pairs), list(range(1, len(ids) + 1))

    return by_group(nodes, edges, group, node, priority, solve, {node: False, "position": True})


def group_levels(nodes: DataFrame, edges: DataFrame, group: list[str], node: str, priority: list[str]) -> DataFrame:
    """``topological_levels`` of groups that one task may hold, such as pages: one shuffle instead of joins in rounds."""

    def solve(ids: list, rank: dict, pairs: list) -> tuple[list, list]:
        level = levels_of(ids, rank, pairs)
        return ids, [level[n] for n in ids]

    return by_group(nodes, edges, group, node, priority, solve, {node: False, "level": True})


def forward_edges(nodes: DataFrame, edges: DataFrame, group: list[str], node: str, priority: list[str]) -> DataFrame:
    """(group, src, dst): the edges that lead forward in ``topological_order``, as ``acyclic`` gives them, found where that order is."""

    def solve(ids: list, rank: dict, pairs: list) -> tuple[list, list]:
        at = {n: i for i, n in enumerate(kahn(ids, rank, pairs))}
        kept = [(a, b) for a, b in pairs if a in at and b in at and at[a] < at[b]]
        return [a for a, _ in kept], [b for _, b in kept]

    return by_group(nodes, edges, group, node, priority, solve, {"src": False, "dst": False})


def topological_levels(nodes: DataFrame, edges: DataFrame, group: list[str], node: str, priority: list[str], each: Callable[[int], None] | None = None) -> DataFrame:
    """(group, node, level): the round in which a node is ready, from 0; where a group has none ready, its first by (priority, node) is taken.

    Nodes and edges that are left are joined once a round and written, so a graph may exceed any machine; it takes as many rounds as its
    longest path has nodes.  ``each`` is told the nodes that are left before every round.
    """
    key = [*group, node]
    left = written(nodes.select(*key, F.struct(*(F.coalesce(F.col(p), F.lit(0.0)).alias(f"p{i}") for i, p in enumerate(priority)), F.col(node).alias("n")).alias("rank")), "nodes")
    e = edges.select(*group, "src", "dst").where("src != dst").distinct()
    inside = left.select(*group, F.col(node).alias("src")), left.select(*group, F.col(node).alias("dst"))
    e = written(e.join(inside[0], [*group, "src"], "left_semi").join(inside[1], [*group, "dst"], "left_semi"), "edges")
    out, level = [], 0
    while n := left.count():
        if each:
            each(n)
        waiting = e.select(*group, F.col("dst").alias(node)).distinct().withColumn("waits", F.lit(True))
        marked = left.join(waiting, key, "left").withColumn("waits", F.coalesce("waits", F.lit(False)))
        of_group = marked.groupBy(*group).agg(F.bool_and("waits").alias("stuck"), F.min("rank").alias("least"))
        now = marked.join(of_group, group).withColumn("ready", ~F.col("waits") | (F.col("stuck") & (F.col("rank") == F.col("least"))))
        now = written(now.select(*key, "rank", "ready"), "round")
        out.append(now.where("ready").select(*key, F.lit(level).alias("level")))
        left = now.where("NOT ready").drop("ready")
        e = written(e.join(now.where("ready").select(*group, F.col(node).alias("src")), [*group, "src"], "left_anti").join(now.where("ready").select(*group, F.col(node).alias("dst")), [*group, "dst"], "left_anti"), "edges")
        level += 1
    if not out:
        return nodes.select(*key, F.lit(0).alias("level")).limit(0)
    return written(reduce(DataFrame.unionByName, out), "levels")


def acyclic(edges: DataFrame, order: DataFrame, group: list[str], node: str) -> DataFrame:
    """The edges that lead forward in an order (group, node, position): without cycles."""
    at = lambda end: order.select(*group, F.col(node).alias(end), F.col("position").alias(f"{end}_at"))
    return edges.join(at("src"), [*group, "src"]).join(at("dst"), [*group, "dst"]).where("src_at < dst_at").drop("src_at", "dst_at")


def alignment(found: DataFrame, wanted: DataFrame, group: list[str], node: str) -> DataFrame:
    """(group, distance): mean distance between each node's places in two orders (group, node, position), as a share of the longer one;
    a node that the wanted order lacks counts 1, as does a group that only one of them has."""
    ends = found.select(*group, node, F.col("position").alias("fa")).unionByName(wanted.select(*group, node, F.col("position").alias("fb")), allowMissingColumns=True)
    # all that follows is within a group, so one shuffle by groups serves it
    at = ends.repartition(*group).groupBy(*group, node).agg(F.max("fa").alias("fa"), F.max("fb").alias("fb"))
    place = lambda c: F.when(F.col(c).isNotNull(), F.row_number().over(Window.partitionBy(*group).orderBy(F.asc_nulls_last(c))))
    both = at.select(*group, place("fa").alias("a"), place("fb").alias("b")).groupBy(*group).agg(F.count("a").alias("na"), F.count("b").alias("nb"), F.sum(F.abs(F.col("a") - F.col("b"))).alias("moved"), F.count_if(F.col("a").isNotNull() & F.col("b").isNull()).alias("alone"))
    distance = F.when((F.col("na") == 0) | (F.col("nb") == 0), 1.0).otherwise((F.coalesce("moved", F.lit(0)) / F.greatest("na", "nb") + F.col("alone")) / F.col("na"))
    return both.select(*group, distance.alias("distance"))


def curvatures(edges: DataFrame, nodes: DataFrame, group: list[str], node: str, fragile: float = -0.3) -> DataFrame:
    """(group, src, dst, curvature, is_fragile): 1 less the distance of an edge's ends, and whether that is under ``fragile``; 0 for an edge with
    an end that is not there or has no place.

    nodes: (group, node, x, y); an edge within a group meets just its two ends.
    """
    at = lambda end: nodes.select(*group, F.col(node).alias(end), F.col("x").alias(f"{end}_x"), F.col("y").alias(f"{end}_y"))
    placed = edges.join(at("src"), [*group, "src"], "left").join(at("dst"), [*group, "dst"], "left")
    dx, dy = F.col("src_x") - F.col("dst_x"), F.col("src_y") - F.col("dst_y")
    out = placed.select(*group, "src", "dst", F.coalesce(1 - F.sqrt(dx * dx + dy * dy), F.lit(0.0)).alias("curvature"))
    return out.withColumn("is_fragile", F.col("curvature") < fragile)
