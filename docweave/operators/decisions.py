"""Scores, tests and choices over pre-aggregated statistics: each is an expression or one grouped aggregate."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: grades by score, random indices of pairwise matrices by size, agents' prices per 1,000 tokens in and out
GRADES = [(0.95, "A+"), (0.9, "A"), (0.8, "B"), (0.7, "C"), (0.6, "D")]
RANDOM_INDEX = [0.0, 0.0, 0.58, 0.9, 1.12, 1.24, 1.32, 1.41, 1.45, 1.49]
#: Cumulative shares of a Poisson variable of mean 1: 0, 1, 2, ... draws.
POISSON = [0.367879441171, 0.735758882343, 0.919698602929, 0.981011843124, 0.996340153173, 0.999405815182, 0.999916758850]


def moments(df: DataFrame, by: list[str], value: Column) -> DataFrame:
    return df.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))


def one_sample(m: DataFrame, expected: float, known_sd: float) -> DataFrame:
    """Student's t against an expected mean, z with a known deviation, and Cohen's d, from moments."""
    away, root = F.col("mean") - expected, F.sqrt("n")
    return m.withColumns({"t": F.try_divide(away, F.try_divide(F.col("sd"), root)), "z": F.try_divide(away, F.try_divide(F.lit(known_sd), root)), "d": F.try_divide(away, F.col("sd")), "df": F.col("n") - 1})


def bootstrap(df: DataFrame, by: str, key: str, value: str, resamples: int) -> DataFrame:
    """(by, resample, mean): Poisson resamples.  A row's weight in each comes from a hash of its key, so no row is moved or drawn
    twice; weights are summed where the rows are."""
    draws = df.select(by, key, value, F.explode(F.sequence(F.lit(1), F.lit(resamples))).alias("resample"))
    u = F.conv(F.substring(F.md5(F.concat_ws(":", F.col(key).cast("string"), F.col("resample").cast("string")).cast("binary")), 1, 8), 16, 10).cast("double") / float(1 << 32)
    weight = reduce(lambda a, p: a + F.when(u >= p, 1).otherwise(0), POISSON, F.lit(0))
    return draws.withColumn("w", weight).groupBy(by, "resample").agg((F.sum(F.col("w") * F.col(value)) / F.sum("w")).alias("mean"))


def grade(score: Column) -> Column:
    out = F.lit("F")
    for least, letter in reversed(GRADES):
        out = F.when(score >= least, letter).otherwise(out)
    return out


def posterior(prior: float, present: list[Column], absent: list[float]) -> Column:
    """Naive Bayes: likelihoods of signals under importance, and without it."""
    yes = reduce(lambda a, b: a * b, present, F.lit(prior))
    no = F.lit((1 - prior) * reduce(lambda a, b: a * b, absent))
    return F.when(yes + no == 0, 0.0).otherwise(yes / (yes + no))


def softmax(df: DataFrame, by: str, key: str, logit: str, temperature: float, low: float, high: float) -> DataFrame:
    """(by, key, weight): softmax within each group, clipped to [low, high] and scaled to sum 1 again."""
    top = df.groupBy(by).agg(F.max(F.col(logit) / temperature).alias("top"))
    e = df.join(top, by).withColumn("e", F.exp(F.col(logit) / temperature - F.col("top")))
    p = e.join(e.groupBy(by).agg(F.sum("e").alias("sum")), by).withColumn("p", F.least(F.lit(high), F.greatest(F.lit(low), F.col("e") / F.col("sum"))))
    return p.join(p.groupBy(by).agg(F.sum("p").alias("all")), by).select(by, key, (F.col("p") / F.col("all")).alias("weight"))


def combined(scores: list[Column], weights: list[float]) -> dict[str, Column]:
    """Linear, geometric, harmonic, greatest and least combinations of scores under weights of sum 1."""
    floor = [F.greatest(s, F.lit(1e-9)) for s in scores]
    add = lambda parts: reduce(lambda a, b: a + b, parts)
    return {
        "linear": add([w * s for s, w in zip(scores, weights)]), "geometric": F.exp(add([w * F.ln(s) for s, w in zip(floor, weights)])), "harmonic": 1 / add([w / s for s, w in zip(floor, weights)]),
        "most": F.greatest(*scores), "least": F.least(*scores),
    }


def adapted(history: DataFrame, by: str, weights: dict[str, float], rating: str, rate: float) -> DataFrame:
    """(by, name, weight): weights moved by their covariance with the rating where a group has three attempts, floor 0.01, sum 1."""
    cov = history.groupBy(by).agg(F.count("*").alias("n"), *(F.covar_samp(name, rating).alias(name) for name in weights))
    moved = {n: F.when(F.col("n") >= 3, F.greatest(F.lit(0.01), F.lit(w) + rate * F.coalesce(F.col(n), F.lit(0.0)))).otherwise(F.lit(w)) for n, w in weights.items()}
    wide = cov.select(by, "n", *(c.alias(n) for n, c in moved.items()))
    total = reduce(lambda a, b: a + b, (F.col(n) for n in weights))
    scaled = wide.select(by, *(F.when(F.col("n") >= 3, F.col(n) / total).otherwise(F.col(n)).alias(n) for n in weights))
    return scaled.unpivot([by], list(weights), "name", "weight")


def upper_bounds(pulls: DataFrame, arm: str, reward: str) -> DataFrame:
    """(arm, n, mean, bound): UCB1 of each arm."""
    arms = pulls.groupBy(arm).agg(F.count("*").alias("n"), F.avg(reward).alias("mean"))
    total = arms.agg(F.sum("n")).first()[0] or 1
    return arms.withColumn("bound", F.col("mean") + F.sqrt(2 * F.log(F.lit(float(total))) / F.col("n")))


def consistency(weights: list[float], matrix: list[list[float]]) -> float:
    """Consistency ratio of a pairwise comparison matrix under given weights."""
    n = len(weights)
    if n <= 2:
        return 0.0
    largest = sum(sum(a * w for a, w in zip(row, weights)) / weights[i] for i, row in enumerate(matrix)) / n
    index = RANDOM_INDEX[n - 1] if n <= len(RANDOM_INDEX) else RANDOM_INDEX[-1]
    return (largest - n) / (n - 1) / index if index else 0.0


def least_risk(priors: DataFrame, losses: DataFrame, by: str) -> DataFrame:
    """(by, action, risk): the action of least expected loss; priors (by, state, p), losses (action, state, loss)."""
    risk = priors.join(F.broadcast(losses), "state").groupBy(by, "action").agg(F.round(F.sum(F.col("p") * F.col("loss")), 9).alias("risk"))
    return risk.groupBy(by).agg(F.min(F.struct("risk", "action")).alias("best")).select(by, "best.action", "best.risk")
