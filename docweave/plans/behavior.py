"""Clicks, sessions, trends, billing, experiments, caches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docweave.operators import behavior as B
from docweave.plans.base import query
from docweave.sources.relations import CLICKS_SQL, clicks, table

PRICES = {"view": 0.001, "click": 0.01, "signup": 1.5, "purchase": 2.0}
_PRICE = "CASE event_type " + " ".join(f"WHEN '{k}' THEN CAST({v} AS DOUBLE)" for k, v in PRICES.items()) + " ELSE CAST(0.005 AS DOUBLE) END"


def events(spark: SparkSession, d: str) -> DataFrame:
    """Event times as instants, in the session's zone."""
    return table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


_CLICK = "count(*) AS queries, round(avg(CASE WHEN len(click_ranks) > 0 THEN 1.0 ELSE 0.0 END), 6) AS ctr, round(avg(CASE WHEN list_min(click_ranks) > 0 THEN 1 / list_min(click_ranks) ELSE 0 END), 6) AS mrr"


@query(f"WITH {CLICKS_SQL} SELECT {_CLICK} FROM clicks")
def click_metrics(spark: SparkSession, d: str) -> DataFrame:
    return rounded(B.click_metrics(clicks(spark, d), []))


@query(f"WITH {CLICKS_SQL} SELECT user_id, {_CLICK} FROM clicks GROUP BY 1")
def user_click_metrics(spark: SparkSession, d: str) -> DataFrame:
    return rounded(B.click_metrics(clicks(spark, d), ["user_id"]))


@query("""WITH g AS (SELECT user_id, ts, event_id, CASE WHEN ts - lag(ts) OVER w >= INTERVAL 30 MINUTE OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM g), t AS (SELECT user_id, s, count(*) AS n, min(ts) AS a, max(ts) AS b FROM s GROUP BY 1, 2)
SELECT user_id, count(*) AS sessions, round(avg(epoch(b) - epoch(a)), 3) AS mean_seconds, max(n) AS longest FROM t GROUP BY 1""")
def session_durations(spark: SparkSession, d: str) -> DataFrame:
    s = B.sessions(events(spark, d), "user_id", "ts", 30)
    return s.groupBy("user_id").agg(F.count("*").alias("sessions"), F.round(F.avg(F.col("last").cast("double") - F.col("first").cast("double")), 3).alias("mean_seconds"), F.max("events").alias("longest"))


@query("SELECT user_id, count(*) AS events, count(DISTINCT event_type) AS types, round(sum(value), 4) AS value, arg_max(event_type, (ts, event_id)) AS last_type, CAST(min(ts) AS DATE)::VARCHAR AS first_day FROM events GROUP BY 1")
def user_profiles(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).groupBy("user_id").agg(F.count("*").alias("events"), F.count_distinct("event_type").alias("types"), F.round(F.sum("value"), 4).alias("value"), F.max_by("event_type", F.struct("ts", "event_id")).alias("last_type"), F.min(F.to_date("ts")).cast("string").alias("first_day"))


_DAILY = "daily AS (SELECT event_type, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INTEGER) AS day, sum(value) AS value FROM events GROUP BY 1, 2)"


def daily(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).groupBy("event_type", F.date_diff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).alias("day")).agg(F.sum("value").alias("value"))


@query(f"WITH {_DAILY} SELECT event_type, day, round(value, 6) AS value, round(avg(value) OVER (PARTITION BY event_type ORDER BY day ROWS 6 PRECEDING), 6) AS sma FROM daily")
def sma_daily_value(spark: SparkSession, d: str) -> DataFrame:
    return rounded(B.moving_average(daily(spark, d), ["event_type"], "day", "value", 7), 6)


@query(f"WITH RECURSIVE {_DAILY}, n AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY day) AS i FROM daily), e AS (SELECT event_type, day, i, value AS ema FROM n WHERE i = 1 UNION ALL SELECT n.event_type, n.day, n.i, 0.25 * n.value + 0.75 * e.ema FROM n JOIN e ON n.event_type = e.event_type AND n.i = e.i + 1) SELECT event_type, day, round(ema, 6) AS ema FROM e")
def ema_daily_value(spark: SparkSession, d: str) -> DataFrame:
    return rounded(B.exponential_average(daily(spark, d), ["event_type"], "day", "value", 7), 6)


@query(f"WITH {_DAILY} SELECT event_type, round(regr_slope(value, day), 4) AS slope, round(regr_intercept(value, day), 4) AS intercept, round(regr_r2(value, day), 4) AS r2, round(sqrt((regr_syy(value, day) - regr_slope(value, day) * regr_sxy(value, day)) / (count(*) - 2) / regr_sxx(value, day)), 4) AS slope_error, CASE WHEN regr_slope(value, day) > 1e-5 THEN 'up' WHEN regr_slope(value, day) < -1e-5 THEN 'down' ELSE 'flat' END AS direction FROM daily GROUP BY 1")
def trend_fit_by_event_type(spark: SparkSession, d: str) -> DataFrame:
    return rounded(B.linear_trend(daily(spark, d), ["event_type"], "day", "value"), 4)


@query(f"WITH {_DAILY}, f AS (SELECT event_type, regr_slope(value, day) AS m, regr_intercept(value, day) AS c FROM daily GROUP BY 1) SELECT event_type, day, round(m * day + c, 4) AS forecast FROM f, (SELECT CAST(unnest(range(30, 37)) AS INTEGER) AS day)")
def forecast(spark: SparkSession, d: str) -> DataFrame:
    f = B.linear_trend(daily(spark, d), ["event_type"], "day", "value")
    return f.select("event_type", F.explode(F.sequence(F.lit(30), F.lit(36))).alias("day"), "slope", "intercept").select("event_type", "day", F.round(F.col("slope") * F.col("day") + F.col("intercept"), 4).alias("forecast"))


@query(f"SELECT event_type AS metric, strftime(date_trunc('month', ts), '%Y-%m-%d') AS period, round(sum(value), 4) AS quantity, round(sum(value) * any_value({_PRICE}), 4) AS amount, round(sum(value) * any_value({_PRICE}) * 1.2, 4) AS with_tax FROM events GROUP BY 1, 2")
def usage_invoice(spark: SparkSession, d: str) -> DataFrame:
    """Monthly usage by metric, priced; a price per metric is a literal, so nothing is joined."""
    price = F.lit(0.005)
    for k, v in PRICES.items():
        price = F.when(F.col("metric") == k, v).otherwise(price)
    u = events(spark, d).groupBy(F.col("event_type").alias("metric"), F.date_format(F.date_trunc("month", "ts"), "yyyy-MM-dd").alias("period")).agg(F.sum("value").alias("quantity"))
    return rounded(u.select("metric", "period", "quantity", (F.col("quantity") * price).alias("amount"), (F.col("quantity") * price * 1.2).alias("with_tax")), 4)


@query("SELECT props AS query_text, count(*) AS n, round(sum(value), 4) AS total, round(avg(value) * (count(*) - 1) * 30, 4) AS monthly_saving FROM events WHERE event_type = 'view' GROUP BY 1 HAVING count(*) >= 3")
def caching_candidates(spark: SparkSession, d: str) -> DataFrame:
    g = events(spark, d).where("event_type = 'view'").groupBy(F.col("props").alias("query_text")).agg(F.count("*").alias("n"), F.sum("value").alias("total"), F.avg("value").alias("mean")).where("n >= 3")
    return rounded(g.select("query_text", "n", "total", (F.col("mean") * (F.col("n") - 1) * 30).alias("monthly_saving")), 4)


_AB = "m AS (SELECT event_type AS variant, count(value) AS n, avg(value) AS mean, var_samp(value) AS var FROM events GROUP BY 1), c AS (SELECT n AS n0, mean AS mean0, var AS var0 FROM m WHERE variant = 'view')"


@query(f"WITH {_AB} SELECT variant, n, round(mean, 6) AS mean, round((mean - mean0) / sqrt(((n - 1) * var + (n0 - 1) * var0) / (n + n0 - 2) * (1 / n + 1 / n0)), 6) AS t, round((mean - mean0) / mean0, 6) AS lift FROM m, c WHERE variant <> 'view'")
def ab_test(spark: SparkSession, d: str) -> DataFrame:
    return rounded(B.two_sample(events(spark, d).withColumnRenamed("event_type", "variant"), "variant", "value", "view"))


@query("WITH r AS (SELECT user_id AS arm, CASE WHEN event_type = 'purchase' THEN 1.0 ELSE 0.0 END AS reward FROM events), a AS (SELECT arm, count(*) AS pulls, avg(reward) AS mean, stddev_pop(reward) AS std, sum(reward) AS wins FROM r GROUP BY 1) SELECT arm, pulls, round(mean, 6) AS mean, round(std, 6) AS std, round(mean + sqrt(2 * ln((SELECT sum(pulls) FROM a)) / pulls), 6) AS ucb, CAST(wins + 1 AS DOUBLE) AS alpha, CAST(pulls - wins + 1 AS DOUBLE) AS beta FROM a")
def bandit_arms(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d).select(F.col("user_id").alias("arm"), (F.col("event_type") == "purchase").cast("double").alias("reward"))
    return rounded(B.arm_statistics(e, "arm", "reward"))


_LIMITED = """WITH RECURSIVE e AS (SELECT user_id, event_id, ts, epoch(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
c AS (SELECT user_id, event_id, ts, i, [t] AS kept, true AS allowed FROM e WHERE i = 1 UNION ALL SELECT e.user_id, e.event_id, e.ts, e.i, CASE WHEN len(list_filter(kept, lambda k: k > e.t - 3600)) < 3 THEN list_append(list_filter(kept, lambda k: k > e.t - 3600), e.t) ELSE list_filter(kept, lambda k: k > e.t - 3600) END,
  len(list_filter(kept, lambda k: k > e.t - 3600)) < 3 FROM c JOIN e ON e.user_id = c.user_id AND e.i = c.i + 1)"""


@query(f"{_LIMITED} SELECT user_id, event_id, ts, allowed FROM c")
def rate_limited(spark: SparkSession, d: str) -> DataFrame:
    """At most three hits in an hour for each user; tests hold it to a fold in plain Python."""
    return B.limited(events(spark, d), "user_id", "ts", 3600, 3)


@query("SELECT event_id, round(CASE WHEN event_type = 'click' THEN 0.6 WHEN event_type = 'purchase' THEN 0.95 WHEN event_type = 'signup' THEN 0.9 WHEN event_type = 'error' THEN 0.2 ELSE 0.7 END, 2) AS rating FROM events")
def implicit_ratings(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("event_type")
    return events(spark, d).select("event_id", F.when(t == "click", 0.6).when(t == "purchase", 0.95).when(t == "signup", 0.9).when(t == "error", 0.2).otherwise(0.7).alias("rating"))


@query("SELECT count(*) AS n, round(avg(value), 6) AS mean, round(median(value), 6) AS median, round(stddev_pop(value), 6) AS std, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.9), 6) AS p90, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99, round(stddev_pop(value) / avg(value), 6) AS cv, round(avg(value) / (stddev_samp(value) / sqrt(count(*))), 4) AS t FROM events")
def latency_profile(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("value")
    p = lambda q: F.percentile(v, F.lit(q))
    return rounded(events(spark, d).agg(F.count("*").alias("n"), F.avg(v).alias("mean"), F.median(v).alias("median"), F.stddev_pop(v).alias("std"), p(0.5).alias("p50"), p(0.9).alias("p90"), p(0.95).alias("p95"), p(0.99).alias("p99"), (F.stddev_pop(v) / F.avg(v)).alias("cv"), F.round(F.avg(v) / (F.stddev_samp(v) / F.sqrt(F.count("*"))), 4).alias("t")))


@query("WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS i FROM events) SELECT user_id, count(*) AS n, round(CASE WHEN max(epoch(ts)) > min(epoch(ts)) THEN (count(*) - 1) / (max(epoch(ts)) - min(epoch(ts))) ELSE 0 END, 9) AS per_second FROM r WHERE i <= 50 GROUP BY 1")
def recent_access_rate(spark: SparkSession, d: str) -> DataFrame:
    """Accesses per second over each user's last 50."""
    r = events(spark, d).withColumn("i", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id")))).where("i <= 50")
    s = F.max(F.col("ts").cast("double")) - F.min(F.col("ts").cast("double"))
    return r.groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.when(s > 0, (F.count("*") - 1) / s).otherwise(0.0), 9).alias("per_second"))


@query("SELECT a, b, n, round((n + 0.05) / (sum(n) OVER (PARTITION BY a) + 0.05 * (SELECT count(DISTINCT event_type) FROM events)), 6) AS p FROM (SELECT a, b, count(*) AS n FROM (SELECT event_type AS a, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events) WHERE b IS NOT NULL GROUP BY 1, 2)")
def markov_transitions(spark: SparkSession, d: str) -> DataFrame:
    """Smoothed transition probabilities between a user's successive event types."""
    e = events(spark, d).select(F.col("event_type").alias("a"), F.lead("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("b"))
    n = e.where("b IS NOT NULL").groupBy("a", "b").agg(F.count("*").alias("n"))
    states = events(spark, d).agg(F.count_distinct("event_type")).first()[0]
    total = F.sum("n").over(Window.partitionBy("a"))
    return n.select("a", "b", "n", F.round((F.col("n") + 0.05) / (total + 0.05 * states), 6).alias("p"))
