"""Rank fusion over (method, item_id, score)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docweave.operators.ranks import with_below


def normalised(weights: dict[str, float], methods: list[str], default: float) -> dict[str, float]:
    """Weights of the methods present, scaled to sum 1."""
    w = {m: weights.get(m, default) for m in methods}
    total = sum(w.values())
    return {m: x / total for m, x in w.items()} if total > 0 else w


def weight_of(weights: dict[str, float]) -> Column:
    out = F.lit(0.0)
    for m, w in weights.items():
        out = F.when(F.col("method") == m, F.lit(float(w))).otherwise(out)
    return out


def starts(scores: DataFrame) -> Column:
    """Rows of the methods before a row's own, in order; there are few methods."""
    out, held = F.lit(0), 0
    for r in sorted(scores.groupBy("method").count().collect(), key=lambda r: r.method):
        out = F.when(F.col("method") == r.method, F.lit(held)).otherwise(out)
        held += r["count"]
    return out


def ranked(scores: DataFrame, bounded: bool = False) -> DataFrame:
    """With rank within each method, from 1; ties to the smaller item.

    Whole score lists are ranked by ranges, so a method's rows never meet in one task; ``bounded`` lists (a few rows) in a window.
    """
    if bounded:
        return scores.withColumn("rank", F.row_number().over(Window.partitionBy("method").orderBy(F.desc("score"), "item_id")))
    placed = with_below(scores.withColumn("_at", F.struct("method", (-F.col("score")).alias("s"), "item_id")), "_at")
    return placed.withColumn("rank", (F.col("below") - starts(scores) + 1).cast("int")).drop("_at", "below")


def reciprocal_rank(scores: DataFrame, weights: dict[str, float], k: int = 60, first: int = 1, bounded: bool = False) -> DataFrame:
    """Sum of weight / (k + rank); ``first`` is the best rank (0 or 1)."""
    r = ranked(scores, bounded)
    return r.groupBy("item_id").agg(F.sum(weight_of(weights) / (k + F.col("rank") + (first - 1))).alias("fused"), F.array_sort(F.collect_set("method")).alias("methods"))


def borda(scores: DataFrame, weights: dict[str, float], last: int = 0) -> DataFrame:
    """Sum of weight x max(n - rank, 0), n being the items in all; the last place is worth ``last``."""
    n = scores.agg(F.count_distinct("item_id")).first()[0]
    points = F.greatest(F.lit(n) - F.col("rank") + last, F.lit(0))
    return ranked(scores).groupBy("item_id").agg(F.sum(weight_of(weights) * points).alias("fused"))


def min_max(scores: DataFrame) -> DataFrame:
    """Scores scaled to 0..1 within each method; all 0 where they are equal.  Extremes are aggregated, then joined back."""
    ends = scores.groupBy("method").agg(F.min("score").alias("low"), F.max("score").alias("high"))
    span = F.when(F.col("high") - F.col("low") < 1e-12, 1.0).otherwise(F.col("high") - F.col("low"))
    return scores.join(F.broadcast(ends), "method").select("method", "item_id", ((F.col("score") - F.col("low")) / span).alias("score"))


def weighted_sum(scores: DataFrame, weights: dict[str, float]) -> DataFrame:
    return min_max(scores).groupBy("item_id").agg(F.sum(weight_of(weights) * F.col("score")).alias("fused"))


def strict_wins(scores: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Sum of weight x items that score strictly lower."""
    placed = with_below(scores.withColumn("_at", F.struct("method", "score")), "_at")
    lower = F.col("below") - starts(scores)
    return placed.groupBy("item_id").agg(F.sum(weight_of(weights) * lower).alias("fused"))


def copeland(scores: DataFrame, weights: dict[str, float], top: int = 60) -> DataFrame:
    """Pairwise contests: an item beats another if methods that rank it better weigh more; wins less losses, scaled to 0..1.

    Every pair is a contest, so contestants are the items of the methods' ``top`` lists: a bounded number.
    """
    r = ranked(scores, bounded=True).where(F.col("rank") <= top)  # each task keeps its first rows before the window
    methods = list(weights)
    wide = r.groupBy("item_id").agg(*(F.coalesce(F.max(F.when(F.col("method") == m, F.col("rank"))), F.lit(999999)).alias(f"r{i}") for i, m in enumerate(methods)))
    other = wide.select(F.col("item_id").alias("other"), *(F.col(f"r{i}").alias(f"o{i}") for i in range(len(methods))))
    margin = sum((F.signum(F.col(f"o{i}") - F.col(f"r{i}")) * weights[m] for i, m in enumerate(methods)), F.lit(0.0))
    won = wide.join(F.broadcast(other), F.col("item_id") != F.col("other")).groupBy("item_id").agg(F.sum(F.signum(F.round(margin, 9))).alias("score"))
    return min_max(won.withColumn("method", F.lit("copeland"))).select("item_id", F.col("score").alias("fused"))


def positional(scores: DataFrame, decay: float = 0.95) -> DataFrame:
    """score x decay^(rank - 1) within each method."""
    return ranked(scores).select("method", "item_id", "rank", (F.col("score") * F.pow(F.lit(decay), F.col("rank") - 1)).alias("score"))


def agreement(scores: DataFrame, weights: dict[str, float]) -> DataFrame:
    """mean and spread of scaled scores over methods, and a confidence: weighted mean x (1 - spread / greatest spread)."""
    s = min_max(scores).groupBy("item_id").agg(F.sum(weight_of(weights) * F.col("score")).alias("composite"), F.stddev_pop("score").alias("spread"))
    top = s.agg(F.max("spread")).first()[0] or 1.0
    return s.select("item_id", "composite", "spread", (F.col("composite") * (1 - F.col("spread") / F.lit(top or 1.0))).alias("confidence"))
