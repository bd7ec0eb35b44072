"""Classification of questions, memory tiers, priorities, permissions, decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docweave.operators.graphs import written

# fixed values: question types in order of precedence, their words, confidences, and the share of the semantic leg
QUESTION_TYPES = [
    ("temporal", r"\b(year|month|quarter|q[1-4]|fiscal|fy\d{2}|fy\d{4}|timeline|date|schedule)\b", 0.85, 0.25),
    ("aggregation", r"\b(sum|average|mean|total|aggregate|stats|statistics|count|min|max|highest|lowest|summing|avg)\b", 0.90, 0.15),
    ("numerical", r"\b(how (many|much)|percent|percentage|rate|cost|price|revenue|sales|profit|amount|\d+(\.\d+)?)\b", 0.80, 0.20),
    ("structural", r"\b(below|above|next to|right of|left of|column|row|coordinates|visual|layout)\b", 0.85, 0.15),
    ("layout", r"\b(header|footer|page number|margin|sidebar|title|subtitle|caption)\b", 0.80, 0.07),
    ("template", r"\b(template|form|invoice|statement|receipt|po|purchase order|contract|format)\b", 0.85, 0.09),
    ("recurrence", r"\b(duplicate|repeat|recurring|redundant|pattern|overlap|identical)\b", 0.80, 0.06),
    ("graph", r"\b(connect|relates|link|reference|relationship|dependency|centrality|neighbor|path)\b", 0.85, 0.18),
    ("entity", r"\b(who|when|where|which|person|organization|company|location|date|dollar)\b", 0.75, 0.68),
    ("semantic", r"\b(summarize|explain|what is|why|how does|context|meaning|concept)\b", 0.90, 0.75),
]
UNKNOWN = ("unknown", 0.50, 0.50)


def question_type(text: Column) -> Column:
    """(type, confidence, semantic_weight) of the first type whose words occur."""
    q = F.trim(F.lower(text))
    out = F.struct(F.lit(UNKNOWN[0]).alias("type"), F.lit(UNKNOWN[1]).alias("confidence"), F.lit(UNKNOWN[2]).alias("semantic_weight"))
    for name, pattern, confidence, weight in reversed(QUESTION_TYPES):
        out = F.when(q.rlike(pattern), F.struct(F.lit(name).alias("type"), F.lit(confidence).alias("confidence"), F.lit(weight).alias("semantic_weight"))).otherwise(out)
    return out


def keep_score(recency_seconds: Column, frequency: Column, importance: Column) -> Column:
    """What a memory item is worth keeping: the lowest go first."""
    return 0.4 / (1 + recency_seconds) + 0.4 * F.least(frequency / 100, F.lit(1.0)) + 0.2 * importance


def promotion_score(recency_seconds: Column, frequency: Column, importance: Column) -> Column:
    return 0.4 * F.least(frequency, F.lit(1.0)) + 0.4 * importance + 0.2 / (1 + recency_seconds)


def evicted(items: DataFrame, level: str, key: str, size: str, score: str, need: int) -> DataFrame:
    """Items of each level to drop, lowest score first, until ``need`` is free."""
    before = F.coalesce(F.sum(size).over(Window.partitionBy(level).orderBy(score, key).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return items.withColumn("freed_before", before).where(F.col("freed_before") < need).select(level, key, score)


def priority(importance: Column, confidence: Column, quality: Column, tokens: Column) -> Column:
    return (0.4 * importance + 0.3 * confidence + 0.3 * quality) / F.log(2 + tokens / 100)


def closure(parents: DataFrame, child: str, parent: str, depth: int) -> DataFrame:
    """(child, ancestor): all that a role inherits from, itself included, up to ``depth`` steps."""
    seen = parents.select(F.col(child).alias("role")).unionByName(parents.select(F.col(parent).alias("role"))).distinct().select("role", F.col("role").alias("ancestor"))
    front = seen
    for _ in range(depth):
        # each step is written, or plans would double with every step
        front, seen = written(front, "front"), written(seen, "seen")
        step = front.join(parents.select(F.col(child).alias("ancestor"), F.col(parent).alias("up")), "ancestor").select("role", F.col("up").alias("ancestor")).distinct()
        front = step.join(seen, ["role", "ancestor"], "left_anti")
        seen = seen.unionByName(front)
    return seen.distinct()


def z_anomalies(df: DataFrame, series: str, value: str, limit: float) -> DataFrame:
    """Rows over ``limit`` population deviations from their series' mean; moments are aggregated and joined back."""
    m = df.groupBy(series).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.count("*").alias("n"))
    z = (F.col(value) - F.col("mean")) / F.col("std")
    return df.join(m, series).where((F.col("n") >= 3) & (F.col("std") > 0)).withColumn("z", z).where(F.abs("z") > limit)


def geometric_weights(judgements: DataFrame, row: str, value: str) -> DataFrame:
    """(row, weight): priorities of a pairwise comparison table by geometric means, scaled to sum 1."""
    g = judgements.groupBy(row).agg(F.exp(F.avg(F.log(value))).alias("g"))
    return g.join(F.broadcast(g.agg(F.sum("g").alias("t")))).select(row, (F.col("g") / F.col("t")).alias("weight"))


def posterior(evidence: DataFrame, claim: str, prior: str, ratio: str) -> DataFrame:
    """(claim, belief): prior odds times likelihood ratios; the order of evidence does not matter."""
    e = evidence.groupBy(claim).agg(F.first(prior).alias("p"), F.sum(F.log(ratio)).alias("s"))
    odds = F.col("p") / (1 - F.col("p")) * F.exp("s")
    return e.select(claim, (odds / (1 + odds)).alias("belief"))


def shard(key: Column, primes: list[int], thresholds: list[int]) -> Column:
    """The last shard j whose prime leaves a remainder under its threshold, else 0."""
    h = F.conv(F.substring(F.md5(key.cast("string").cast("binary")), 1, 8), 16, 10).cast("long")
    out = F.lit(0)
    for j, (p, t) in enumerate(zip(primes, thresholds)):
        out = F.when(h % p < t, j).otherwise(out)
    return out
