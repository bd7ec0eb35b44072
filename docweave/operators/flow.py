"""Expected steps of a random walk to a set of nodes, by a sparse linear solver in rounds."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.operators.graphs import components, written


@dataclass(frozen=True)
class Hitting:
    """(node, steps): null where no target can be reached; rounds taken and the relative residual they ended with."""

    steps: DataFrame
    rounds: int
    residual: float


def hitting_times(edges: DataFrame, targets: DataFrame, rounds: int = 500, tolerance: float = 1e-10) -> Hitting:
    """Mean steps to the first target (``node``) of a walk along an undirected weighted graph (src, dst, weight).

    Off the targets, steps h solve (I - Q) h = 1.  Multiplied by the nodes' total weights that is the graph's Laplacian without the
    targets, which is symmetric and positive, so conjugate gradients solve it: a round is one join with the edges, one
    sum by node, and two sums over all nodes.  It ends when the residual falls to ``tolerance`` of the right side.  Both directions and
    repeated edges add up; weights that are not positive, and nulls, do not count.  A target takes 0 steps.
    """
    e = edges.where("weight > 0 AND src IS NOT NULL AND dst IS NOT NULL").select("src", "dst", "weight")
    both = e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")).groupBy("src", "dst").agg(F.sum("weight").alias("w"))
    both = written(both, "both")
    ends = targets.select("node").where("node IS NOT NULL").distinct()
    known = written(both.groupBy(F.col("src").alias("node")).agg(F.sum("w").alias("degree")).join(ends.withColumn("target", F.lit(True)), "node", "left"), "known")
    # only nodes that reach a target have a finite time
    parts = components(both.select("src", "dst"))
    reached = parts.join(known.where("target").select("node"), "node", "left_semi").select("component").distinct()
    free = written(known.where("target IS NULL").join(parts.join(reached, "component", "left_semi").select("node"), "node", "left_semi").select("node", "degree"), "free")
    inner = both.join(free.select(F.col("node").alias("src")), "src", "left_semi").join(free.select(F.col("node").alias("dst")), "dst", "left_semi")
    inner = written(inner.select("src", "dst", "w"), "inner")
    # h = 0, r = p = degree; scaling by degrees (the preconditioner) makes z = r / degree
    state = written(free.select("node", "degree", F.lit(0.0).alias("h"), F.col("degree").alias("r"), F.lit(1.0).alias("p")), "state")
    first = state.agg(F.sum("degree").alias("rz")).first().rz
    rz, took = first or 0.0, 0
    while took < rounds and rz > tolerance**2 * (first or 1.0):
        took += 1
        met = inner.join(state.select(F.col("node").alias("dst"), "p"), "dst").groupBy(F.col("src").alias("node")).agg(F.sum(F.col("w") * F.col("p")).alias("wp"))
        applied = written(state.join(met, "node", "left").withColumn("ap", F.col("degree") * F.col("p") - F.coalesce("wp", F.lit(0.0))).drop("wp"), "applied")
        bend = applied.agg(F.sum(F.col("p") * F.col("ap")).alias("x")).first().x
        step = rz / bend
        moved = applied.select("node", "degree", (F.col("h") + step * F.col("p")).alias("h"), (F.col("r") - step * F.col("ap")).alias("r"), "p")
        left = moved.agg(F.sum(F.col("r") * F.col("r") / F.col("degree")).alias("x")).first().x
        state = written(moved.withColumn("p", F.col("r") / F.col("degree") + (left / rz) * F.col("p")), "state")
        rz = left
    steps = known.select("node", "target").join(state.select("node", "h"), "node", "left").select("node", F.when(F.col("target"), 0.0).otherwise(F.col("h")).alias("steps"))
    return Hitting(steps, took, (rz / first) ** 0.5 if first else 0.0)
