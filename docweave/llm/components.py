"""Connected components of an edge table, in Spark, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.llm.common import materialize


def star(edges: DataFrame, large: bool) -> DataFrame:
    """One step.  Minima are pre-aggregated before the shuffle and joined back; a hub's edges, which that join would bring
    together, are split by Spark where they are many (adaptive skew join)."""
    e = edges if not large else edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = e.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    joined = e.join(least, "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.where("u != m").select("u", F.col("m").alias("v")))
    return out.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v of one type that has an order): root is the smallest node reachable.

    Each round writes its edges to the shared folder, so lineage stays short.  Ends when every edge leads to a root that has
    no edge upwards, which is when the graph is a set of stars; an empty table gives an empty result.
    """
    now = materialize(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    while True:
        ups = now.groupBy("u").agg(F.count("*").alias("n"))
        inner = now.select(F.col("v").alias("u")).distinct().join(ups.select("u"), "u", "left_semi")
        if ups.where("n > 1").isEmpty() and inner.isEmpty():
            break
        now = materialize(star(star(now, large=True), large=False), "edges")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
