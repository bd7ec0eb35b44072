"""Behaviour, cost and experiment analytics over events."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def click_metrics(clicks: DataFrame, by: list[str]) -> DataFrame:
    """queries, CTR (queries with a click), MRR (1 / least rank, 0 without a click or with a rank of 0 or less)."""
    least = F.array_min("click_ranks")
    return clicks.groupBy(*by).agg(F.count("*").alias("queries"), F.coalesce(F.avg((F.size("click_ranks") > 0).cast("double")), F.lit(0.0)).alias("ctr"), F.coalesce(F.avg(F.when(least > 0, 1 / least).otherwise(0.0)), F.lit(0.0)).alias("mrr"))


def sessions(events: DataFrame, user: str, ts: str, gap_minutes: int) -> DataFrame:
    """(user, session, start, end, events): a session ends after a gap; session windows merge inside each task first."""
    w = F.session_window(ts, f"{gap_minutes} minutes")
    return events.groupBy(user, w.alias("w")).agg(F.count("*").alias("events"), F.min(ts).alias("first"), F.max(ts).alias("last"))


def moving_average(df: DataFrame, by: list[str], order: str, value: str, width: int) -> DataFrame:
    """Trailing mean over up to ``width`` rows."""
    return df.withColumn("sma", F.avg(value).over(Window.partitionBy(*by).orderBy(order).rowsBetween(1 - width, 0)))


def exponential_average(df: DataFrame, by: list[str], order: str, value: str, width: int) -> DataFrame:
    """(by..., ema array): e0 = x0, then alpha x + (1 - alpha) e with alpha = 2 / (width + 1), folded over a series."""
    alpha = 2.0 / (width + 1)
    s = df.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).cast("double").alias("v")))).alias("s"))
    fold = F.aggregate("s", F.array().cast("array<double>"), lambda a, x: F.concat(a, F.array(F.when(F.size(a) == 0, x["v"]).otherwise(alpha * x["v"] + (1 - alpha) * F.element_at(F.when(F.size(a) == 0, F.array(F.lit(0.0))).otherwise(a), -1)))))
    return s.select(*by, F.explode(F.arrays_zip(F.transform("s", lambda x: x["o"]).alias("o"), fold.alias("ema"))).alias("z")).select(*by, F.col("z.o").alias(order), F.col("z.ema").alias("ema"))


def linear_trend(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """slope, intercept, r2, direction (flat within 1e-5), standard error of the slope."""
    slope, r2 = F.regr_slope(y, x), F.regr_r2(y, x)
    rest = F.regr_syy(y, x) - slope * F.regr_sxy(y, x)
    n = F.regr_count(y, x)
    agg = df.groupBy(*by).agg(slope.alias("slope"), F.regr_intercept(y, x).alias("intercept"), r2.alias("r2"), F.sqrt(F.try_divide(F.try_divide(F.greatest(rest, F.lit(0.0)), n - 2), F.regr_sxx(y, x))).alias("slope_error"))
    return agg.withColumn("direction", F.when(F.col("slope") > 1e-5, "up").when(F.col("slope") < -1e-5, "down").otherwise("flat"))


def two_sample(df: DataFrame, variant: str, value: str, control: str) -> DataFrame:
    """Each other variant against the control: means, pooled t, lift."""
    m = df.groupBy(variant).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.var_samp(value).alias("var"))
    c = m.where(F.col(variant) == control).select(F.col("n").alias("n0"), F.col("mean").alias("mean0"), F.col("var").alias("var0"))
    both = m.where(F.col(variant) != control).join(F.broadcast(c))  # the control is one row
    pooled = F.try_divide((F.col("n") - 1) * F.col("var") + (F.col("n0") - 1) * F.col("var0"), F.col("n") + F.col("n0") - 2)
    t = F.try_divide(F.col("mean") - F.col("mean0"), F.sqrt(pooled * (F.try_divide(F.lit(1), F.col("n")) + F.try_divide(F.lit(1), F.col("n0")))))
    return both.select(variant, "n", "mean", t.alias("t"), F.try_divide(F.col("mean") - F.col("mean0"), F.col("mean0")).alias("lift"))


def arm_statistics(df: DataFrame, arm: str, reward: str) -> DataFrame:
    """pulls, mean, std, upper confidence bound, Beta posterior of a 0/1 reward."""
    a = df.groupBy(arm).agg(F.count("*").alias("pulls"), F.avg(reward).alias("mean"), F.stddev_pop(reward).alias("std"), F.sum(reward).alias("wins"))
    total = a.agg(F.sum("pulls").alias("total"))
    return a.join(F.broadcast(total)).select(arm, "pulls", "mean", "std", (F.col("mean") + F.sqrt(2 * F.log("total") / F.col("pulls"))).alias("ucb"), (F.col("wins") + 1).alias("alpha"), (F.col("pulls") - F.col("wins") + 1).alias("beta"))


def limited(events: DataFrame, key: str, ts: str, seconds: int, limit: int) -> DataFrame:
    """(key, ts, allowed): sliding-window limiter; a hit counts if strictly newer than now - window, refused hits are not kept.

    Each decision depends on those before, so a key's hits are folded in order by Arrow; one key's hits are one group.
    """
    import pandas as pd

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([ts, "event_id"])
        kept: list[float] = []
        allowed = []
        for now in pdf[ts].astype("datetime64[us]").astype("int64") / 1e6:
            while kept and kept[0] <= now - seconds:
                kept.pop(0)
            allowed.append(len(kept) < limit)
            if allowed[-1]:
                kept.append(now)
        return pdf.assign(allowed=allowed)

    return events.select(key, "event_id", ts).groupBy(key).applyInPandas(fold, f"{key} long, event_id long, {ts} timestamp, allowed boolean")
