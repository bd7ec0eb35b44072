"""Graphs as edges (src, dst, edge_type, weight): degrees, ranks, components, neighbourhoods."""

from __future__ import annotations

import atexit
import math
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def written(df: DataFrame, tag: str) -> DataFrame:
    """Cuts lineage: a table in ``spark.checkpoint.dir``; in a folder of this machine only where that is unset on a local master."""
    spark = df.sparkSession
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="docweave-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(folder)
    path = f"{folder.rstrip('/')}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


def parts_for(spark: SparkSession, rows: float, each: int) -> int:
    """Shuffle partitions of about ``each`` rows, no fewer than are set: a number that stays as set lets tasks grow with the table."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(rows / each))


def nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node"))).distinct()


def degrees(edges: DataFrame) -> DataFrame:
    """(node, out_degree, in_degree, centrality): centrality is degree / (n - 1); one shuffle for both directions."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e"))
    d = ends.groupBy("e.node").agg(F.sum("e.o").alias("out_degree"), F.sum("e.i").alias("in_degree"))
    n = d.count()
    return d.select("node", "out_degree", "in_degree", ((F.col("out_degree") + F.col("in_degree")) / F.lit(max(1, n - 1))).alias("centrality"))


def pagerank(edges: DataFrame, rounds: int, damping: float = 0.85, weighted: bool = False, dangling: str = "spread", seeds: DataFrame | None = None) -> DataFrame:
    """(node, rank) after a fixed number of rounds.

    dangling: "spread" gives the rank of nodes without edges to all; "lost" drops it.  seeds: teleport goes to these alone.
    Shares are joined once per round on a node's out-edges and summed; lineage is cut each five rounds.
    """
    w = F.col("weight") if weighted else F.lit(1.0)
    e = edges.groupBy("src", "dst").agg(F.sum(w).alias("w"))
    total = e.groupBy("src").agg(F.sum("w").alias("t"))
    share = written(e.join(total, "src").select("src", "dst", (F.col("w") / F.col("t")).alias("p")), "shares")
    every = nodes(edges)
    n = every.count()
    if seeds is None:
        start = every.withColumn("s", F.lit(1.0 / max(1, n)))
    else:
        k = seeds.count()
        start = every.join(seeds.select("node", F.lit(1.0 / max(1, k)).alias("s")), "node", "left").select("node", F.coalesce("s", F.lit(0.0)).alias("s"))
    start = written(start.join(share.select(F.col("src").alias("node"), F.lit(True).alias("has")).distinct(), "node", "left").select("node", "s", F.coalesce("has", F.lit(False)).alias("has")), "nodes")
    rank = start.select("node", F.col("s").alias("rank"))
    for i in range(rounds):
        got = rank.join(share, rank.node == share.src).groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("rank") * F.col("p")).alias("got"))
        spread = 0.0
        if dangling == "spread":
            spread = rank.join(start.where("NOT has").select("node"), "node").agg(F.coalesce(F.sum("rank"), F.lit(0.0))).first()[0]
        rank = start.join(got, "node", "left").select("node", ((1 - damping) * F.col("s") + damping * (F.coalesce("got", F.lit(0.0)) + F.lit(float(spread)) * F.col("s"))).alias("rank"))
        if i % 5 == 4 or dangling == "spread":
            rank = written(rank, "rank")
    return rank


def breadth_first(edges: DataFrame, source: DataFrame, depth: int, directed: bool = True) -> DataFrame:
    """(node, depth) of nodes within ``depth`` steps of the source nodes; a frontier is joined, then what was seen is left out."""
    e = edges.select("src", "dst")
    if not directed:
        e = e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    e = e.distinct()
    seen = source.select("node", F.lit(0).alias("depth"))
    front = source.select("node")
    for d in range(1, depth + 1):
        front = front.join(e, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct().join(seen.select("node"), "node", "left_anti")
        front = written(front, "front")
        if front.isEmpty():
            break
        seen = seen.unionByName(front.select("node", F.lit(d).alias("depth")))
    return seen


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node of each component, by minima passed along edges with pointer jumps."""
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    both = written(both, "both")
    label = nodes(edges).select("node", F.col("node").alias("component"))
    while True:
        least = both.join(label, both.dst == label.node).groupBy(F.col("src").alias("node")).agg(F.min("component").alias("least"))
        hop = label.join(least, "node", "left").select("node", "component", F.least("component", F.coalesce("least", "component")).alias("next"))
        up = label.select(F.col("node").alias("next"), F.col("component").alias("above"))
        now = written(hop.join(up, "next").select("node", F.col("component").alias("old"), F.least("next", "above").alias("component")), "labels")
        label = now.select("node", "component")
        if now.where("old != component").isEmpty():
            return label


def triangles(edges: DataFrame) -> DataFrame:
    """(node, triangles) of the undirected graph.  Edges point from lower to higher degree, so no hub starts many pairs."""
    und = edges.where("src != dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    deg = und.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("deg"))
    e = und.join(deg.select(F.col("node").alias("a"), F.col("deg").alias("da")), "a").join(deg.select(F.col("node").alias("b"), F.col("deg").alias("db")), "b")
    first = (F.col("da") < F.col("db")) | ((F.col("da") == F.col("db")) & (F.col("a") < F.col("b")))
    o = e.select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("x"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("y"))
    p, q = o.select("x", F.col("y").alias("y1")), o.select("x", F.col("y").alias("y2"))
    t = p.join(q, "x").where("y1 < y2").join(und, (F.col("y1") == F.col("a")) & (F.col("y2") == F.col("b")))
    return t.select(F.explode(F.array("x", "y1", "y2")).alias("node")).groupBy("node").agg(F.count("*").alias("triangles"))


def paths(edges: DataFrame, source: str, target: str, longest: int) -> DataFrame:
    """(path array, length, weight): simple paths between two nodes."""
    e = edges.select("src", "dst", "weight")
    walk = e.where(F.col("src") == source).select(F.array("src", "dst").alias("path"), "weight", F.col("dst").alias("at"))
    out = walk.where(F.col("at") == target)
    for _ in range(longest - 1):
        nxt = e.select(F.col("src").alias("at"), F.col("dst").alias("to"), F.col("weight").alias("w"))
        walk = walk.where(F.col("at") != target).join(nxt, "at").where(~F.array_contains("path", F.col("to"))).select(F.concat("path", F.array("to")).alias("path"), (F.col("weight") + F.col("w")).alias("weight"), F.col("to").alias("at"))
        out = out.unionByName(walk.where(F.col("at") == target))
    return out.select("path", (F.size("path") - 1).alias("length"), "weight")
