"""Tests, scores, costs and choices over orders, events and customers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.operators import decisions as D
from docweave.plans.base import query
from docweave.sources.relations import table


def rounded(df: DataFrame, digits: int = 5) -> DataFrame:
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


@query("SELECT o_orderpriority, count(*) AS n, round(avg(o_totalprice), 5) AS mean, round(stddev_samp(o_totalprice), 5) AS sd, round((avg(o_totalprice) - 150000) / (stddev_samp(o_totalprice) / sqrt(count(*))), 5) AS t, round((avg(o_totalprice) - 150000) / (80000 / sqrt(count(*))), 5) AS z, round((avg(o_totalprice) - 150000) / stddev_samp(o_totalprice), 5) AS d, count(*) - 1 AS df FROM orders GROUP BY 1")
def one_sample_tests(spark: SparkSession, d: str) -> DataFrame:
    return rounded(D.one_sample(D.moments(table(spark, d, "orders"), ["o_orderpriority"], F.col("o_totalprice")), 150000.0, 80000.0))


@query("""WITH p AS (SELECT l_returnflag AS flag, l_extendedprice * (1 - l_discount) - l_extendedprice / (1 + l_tax) AS diff FROM lineitem), m AS (SELECT flag, count(*) AS n, avg(diff) AS mean, stddev_samp(diff) AS sd FROM p GROUP BY 1)
SELECT flag, n, round(mean, 5) AS mean, round(sd, 5) AS sd, round(mean / (sd / sqrt(n)), 5) AS t, round(mean - 1.96 * sd / sqrt(n), 5) AS low, round(mean + 1.96 * sd / sqrt(n), 5) AS high, n - 1 AS df FROM m""")
def paired_tests(spark: SparkSession, d: str) -> DataFrame:
    diff = F.col("l_extendedprice") * (1 - F.col("l_discount")) - F.col("l_extendedprice") / (1 + F.col("l_tax"))
    m = D.moments(table(spark, d, "lineitem").withColumn("flag", F.col("l_returnflag")), ["flag"], diff)
    half = 1.96 * F.col("sd") / F.sqrt("n")
    return rounded(m.withColumns({"t": F.try_divide(F.col("mean"), F.try_divide(F.col("sd"), F.sqrt("n"))), "low": F.col("mean") - half, "high": F.col("mean") + half, "df": F.col("n") - 1}))


_U = "CAST(('0x' || substr(md5(c_custkey || ':' || b), 1, 8)) AS BIGINT) / 4294967296.0"
_POISSON = " + ".join(f"CASE WHEN u >= {p} THEN 1 ELSE 0 END" for p in D.POISSON)


@query(f"""WITH x AS (SELECT c_mktsegment, c_acctbal, b, {_U} AS u FROM customer, range(1, 41) AS r(b)), w AS (SELECT c_mktsegment, b, sum(({_POISSON}) * c_acctbal) / sum({_POISSON}) AS mean FROM x GROUP BY 1, 2)
SELECT c_mktsegment, round(avg(mean), 4) AS mean, round(quantile_cont(mean, CAST(0.025 AS DOUBLE)), 4) AS low, round(quantile_cont(mean, CAST(0.975 AS DOUBLE)), 4) AS high FROM w GROUP BY 1""")
def bootstrap_intervals(spark: SparkSession, d: str) -> DataFrame:
    b = D.bootstrap(table(spark, d, "customer"), "c_mktsegment", "c_custkey", "c_acctbal", 40)
    at = lambda p: F.round(F.expr(f"percentile(mean, {p})"), 4)
    return b.groupBy("c_mktsegment").agg(F.round(F.avg("mean"), 4).alias("mean"), at(0.025).alias("low"), at(0.975).alias("high"))


_SIGNALS = "least(1, c_acctbal / 10000) AS size, CASE WHEN c_custkey % 3 = 0 THEN CAST(0.9 AS DOUBLE) ELSE 0.2 END AS words, (c_nationkey % 10) / CAST(10 AS DOUBLE) AS place"


def signals(spark: SparkSession, d: str) -> DataFrame:
    """Three scores for each customer."""
    return table(spark, d, "customer").select("c_custkey", "c_mktsegment", F.least(F.lit(1.0), F.col("c_acctbal") / 10000).alias("size"), F.when(F.col("c_custkey") % 3 == 0, 0.9).otherwise(0.2).alias("words"), (F.col("c_nationkey") % 10 / 10.0).alias("place"))


@query(f"WITH s AS (SELECT c_custkey, {_SIGNALS} FROM customer), p AS (SELECT c_custkey, size * words * place * 0.3 AS yes, CAST(0.2 AS DOUBLE) * 0.1 * 0.3 * 0.7 AS no FROM s) SELECT c_custkey, round(CASE WHEN yes + no = 0 THEN 0 ELSE yes / (yes + no) END, 8) AS importance FROM p")
def bayes_importance(spark: SparkSession, d: str) -> DataFrame:
    return signals(spark, d).select("c_custkey", F.round(D.posterior(0.3, [F.col(c) for c in ("size", "words", "place")], [0.2, 0.1, 0.3]), 8).alias("importance"))


@query(f"""WITH s AS (SELECT c_custkey, {_SIGNALS} FROM customer), f AS (SELECT c_custkey, size, words, place, greatest(size, 1e-9) AS a, greatest(words, 1e-9) AS b, greatest(place, 1e-9) AS c FROM s)
SELECT c_custkey, round(0.5 * size + 0.3 * words + 0.2 * place, 8) AS linear, round(exp(0.5 * ln(a) + 0.3 * ln(b) + 0.2 * ln(c)), 8) AS geometric, round(1 / (0.5 / a + 0.3 / b + 0.2 / c), 8) AS harmonic, round(greatest(size, words, place), 8) AS most, round(least(size, words, place), 8) AS least FROM f""")
def combined_scores(spark: SparkSession, d: str) -> DataFrame:
    c = D.combined([F.col(x) for x in ("size", "words", "place")], [0.5, 0.3, 0.2])
    return signals(spark, d).select("c_custkey", *(F.round(v, 8).alias(k) for k, v in c.items()))


@query(f"""WITH s AS (SELECT c_custkey, {_SIGNALS} FROM customer), c AS (SELECT c_custkey, place, greatest(0, least(1, 0.3 * greatest(size, 0) + 0.3 * words + 0.2 * greatest(0, 1 - place) + 0.1 * 0.8 + 0.1 * 0.9)) AS overall FROM s)
SELECT c_custkey, round(overall, 8) AS overall, CASE WHEN overall >= 0.95 THEN 'A+' WHEN overall >= 0.9 THEN 'A' WHEN overall >= 0.8 THEN 'B' WHEN overall >= 0.7 THEN 'C' WHEN overall >= 0.6 THEN 'D' ELSE 'F' END AS grade, overall < 0.7 AS below_threshold, place > 0.1 AS high_hallucination FROM c""")
def confidence_grades(spark: SparkSession, d: str) -> DataFrame:
    s = signals(spark, d)
    raw = 0.3 * F.greatest("size", F.lit(0.0)) + 0.3 * F.col("words") + 0.2 * F.greatest(F.lit(0.0), 1 - F.col("place")) + F.lit(0.1 * 0.8) + F.lit(0.1 * 0.9)
    s = s.withColumn("overall", F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw)))
    return s.select("c_custkey", F.round("overall", 8).alias("overall"), D.grade(F.col("overall")).alias("grade"), (F.col("overall") < 0.7).alias("below_threshold"), (F.col("place") > 0.1).alias("high_hallucination"))


@query(f"""WITH s AS (SELECT c_mktsegment AS name, {_SIGNALS} FROM customer), h AS (SELECT name, size, words, place, 1 + 4 * size * words AS rating FROM s), c AS (SELECT name, count(*) AS n, covar_samp(size, rating) AS a, covar_samp(words, rating) AS b, covar_samp(place, rating) AS p FROM h GROUP BY 1),
m AS (SELECT name, n, CASE WHEN n >= 3 THEN greatest(0.01, 0.5 + 0.1 * a) ELSE 0.5 END AS a, CASE WHEN n >= 3 THEN greatest(0.01, 0.3 + 0.1 * b) ELSE 0.3 END AS b, CASE WHEN n >= 3 THEN greatest(0.01, 0.2 + 0.1 * p) ELSE 0.2 END AS p FROM c), w AS (SELECT name, a + b + p AS t, a, b, p FROM m)
SELECT name AS category, 'size' AS name, round(a / t, 5) AS weight FROM w UNION ALL SELECT name, 'words', round(b / t, 5) FROM w UNION ALL SELECT name, 'place', round(p / t, 5) FROM w""")
def adapted_weights(spark: SparkSession, d: str) -> DataFrame:
    h = signals(spark, d).withColumnRenamed("c_mktsegment", "category").withColumn("rating", 1 + 4 * F.col("size") * F.col("words"))
    return rounded(D.adapted(h, "category", {"size": 0.5, "words": 0.3, "place": 0.2}, "rating", 0.1))


@query("""WITH l AS (SELECT c_mktsegment, c_nationkey, avg(c_acctbal) / 1000 AS logit FROM customer GROUP BY 1, 2), e AS (SELECT c_mktsegment, c_nationkey, exp(logit / 2 - max(logit / 2) OVER (PARTITION BY c_mktsegment)) AS e FROM l),
p AS (SELECT c_mktsegment, c_nationkey, least(0.5, greatest(0.01, e / sum(e) OVER (PARTITION BY c_mktsegment))) AS p FROM e) SELECT c_mktsegment, c_nationkey, round(p / sum(p) OVER (PARTITION BY c_mktsegment), 6) AS weight FROM p""")
def softmax_weights(spark: SparkSession, d: str) -> DataFrame:
    logits = table(spark, d, "customer").groupBy("c_mktsegment", "c_nationkey").agg((F.avg("c_acctbal") / 1000).alias("logit"))
    return D.softmax(logits, "c_mktsegment", "c_nationkey", "logit", 2.0, 0.01, 0.5).withColumn("weight", F.round("weight", 6))


@query("WITH a AS (SELECT event_type AS arm, count(*) AS n, avg(value / 100) AS mean FROM events GROUP BY 1) SELECT arm, n, round(mean, 6) AS mean, round(mean + sqrt(2 * ln((SELECT sum(n) FROM a)) / n), 6) AS bound FROM a")
def bandit_bounds(spark: SparkSession, d: str) -> DataFrame:
    pulls = table(spark, d, "events").select(F.col("event_type").alias("arm"), (F.col("value") / 100).alias("reward"))
    return rounded(D.upper_bounds(pulls, "arm", "reward"), 6)


@query("""WITH n AS (SELECT c_nationkey, CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal < 5000 THEN 'small' ELSE 'large' END AS state FROM customer), p AS (SELECT c_nationkey, state, count(*) / sum(count(*)) OVER (PARTITION BY c_nationkey) AS p FROM n GROUP BY 1, 2),
l(action, state, loss) AS (VALUES ('lend', 'debt', 9.0), ('lend', 'small', 2.0), ('lend', 'large', 0.0), ('wait', 'debt', 1.0), ('wait', 'small', 1.0), ('wait', 'large', 4.0), ('deny', 'debt', 0.0), ('deny', 'small', 3.0), ('deny', 'large', 6.0)),
r AS (SELECT c_nationkey, action, round(sum(p * loss), 9) AS risk FROM p JOIN l USING (state) GROUP BY 1, 2) SELECT c_nationkey, arg_min(action, (risk, action)) AS action, round(CAST(min(risk) AS DOUBLE), 6) AS risk FROM r GROUP BY 1""")
def least_risk_actions(spark: SparkSession, d: str) -> DataFrame:
    state = F.when(F.col("c_acctbal") < 0, "debt").when(F.col("c_acctbal") < 5000, "small").otherwise("large")
    counts = table(spark, d, "customer").groupBy("c_nationkey", state.alias("state")).agg(F.count("*").alias("n"))
    p = counts.join(counts.groupBy("c_nationkey").agg(F.sum("n").alias("all")), "c_nationkey").select("c_nationkey", "state", (F.col("n") / F.col("all")).alias("p"))
    rows = [("lend", "debt", 9.0), ("lend", "small", 2.0), ("lend", "large", 0.0), ("wait", "debt", 1.0), ("wait", "small", 1.0), ("wait", "large", 4.0), ("deny", "debt", 0.0), ("deny", "small", 3.0), ("deny", "large", 6.0)]
    return D.least_risk(p, spark.createDataFrame(rows, "action string, state string, loss double"), "c_nationkey").withColumn("risk", F.round("risk", 6))


@query("SELECT o_custkey, count(*) AS n, round((1 + count(*) FILTER (o_orderstatus = 'F')) / CAST(2 + count(*) AS DOUBLE), 6) AS posterior_mean FROM orders GROUP BY 1")
def beta_posteriors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.round((1 + F.count_if(F.col("o_orderstatus") == "F")) / (2 + F.count("*")), 6).alias("posterior_mean"))


#: Prices per 1,000 tokens, in and out; a type without one is local and free.
PRICES = {"purchase": (0.03, 0.06), "click": (0.002, 0.004), "view": (0.0005, 0.0015)}
_PRICES = ", ".join(f"('{k}', CAST({a} AS DOUBLE), CAST({b} AS DOUBLE))" for k, (a, b) in PRICES.items())
_USAGE = f"prices(agent, p_in, p_out) AS (VALUES {_PRICES}), usage AS (SELECT event_id, event_type AS agent, user_id, length(props) AS tokens_in, CAST(floor(value) AS BIGINT) AS tokens_out, coalesce(length(props) / 1000 * p_in + floor(value) / 1000 * p_out, 0) AS cost FROM events LEFT JOIN prices ON agent = event_type)"


def usage(spark: SparkSession, d: str) -> DataFrame:
    """Events as model calls: tokens in by their payload, tokens out by their value, cost by the agent's price."""
    prices = spark.createDataFrame([(k, a, b) for k, (a, b) in PRICES.items()], "agent string, p_in double, p_out double")
    e = table(spark, d, "events").select("event_id", F.col("event_type").alias("agent"), "user_id", F.length("props").cast("long").alias("tokens_in"), F.floor("value").alias("tokens_out"))
    cost = F.coalesce(F.col("tokens_in") / 1000 * F.col("p_in") + F.col("tokens_out") / 1000 * F.col("p_out"), F.lit(0.0))
    return e.join(F.broadcast(prices), "agent", "left").select("event_id", "agent", "user_id", "tokens_in", "tokens_out", cost.alias("cost"))


@query(f"WITH {_USAGE} SELECT agent, user_id % 10 AS section, count(*) AS calls, CAST(sum(tokens_in) AS BIGINT) AS tokens_in, CAST(sum(tokens_out) AS BIGINT) AS tokens_out, round(sum(cost), 8) AS cost, round(1 - sum(tokens_in + tokens_out) / (count(*) * 200.0), 6) AS savings FROM usage GROUP BY GROUPING SETS ((agent), (section), ())")
def token_usage(spark: SparkSession, d: str) -> DataFrame:
    u = usage(spark, d).withColumn("section", F.col("user_id") % 10)
    used = F.sum(F.col("tokens_in") + F.col("tokens_out"))
    g = u.groupingSets([[F.col("agent")], [F.col("section")], []], "agent", "section")
    return g.agg(F.count("*").alias("calls"), F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"), F.round(F.sum("cost"), 8).alias("cost"), F.round(1 - used / (F.count("*") * 200.0), 6).alias("savings"))


@query(f"WITH {_USAGE}, c AS (SELECT count(*) AS queries, sum(cost) AS tokens, sum(tokens_in) * 1e-6 AS storage, count(*) * 2e-5 AS compute FROM usage) SELECT queries, round(tokens, 8) AS token_cost, round(storage, 8) AS storage_cost, round(compute, 8) AS compute_cost, round(tokens + storage + compute, 8) AS total, round((tokens + storage + compute) / queries, 9) AS per_query FROM c")
def query_costs(spark: SparkSession, d: str) -> DataFrame:
    c = usage(spark, d).agg(F.count("*").alias("queries"), F.sum("cost").alias("t"), (F.sum("tokens_in") * 1e-6).alias("s"), (F.count("*") * 2e-5).alias("c"))
    total = F.col("t") + F.col("s") + F.col("c")
    return c.select("queries", F.round("t", 8).alias("token_cost"), F.round("s", 8).alias("storage_cost"), F.round("c", 8).alias("compute_cost"), F.round(total, 8).alias("total"), F.round(total / F.col("queries"), 9).alias("per_query"))


@query(f"WITH {_USAGE} SELECT agent, count(*) AS calls, round(sum(cost) * 0.8 * 30, 8) AS monthly_savings FROM usage WHERE agent = 'purchase' AND tokens_in <= 15 AND tokens_out <= 30 GROUP BY 1")
def routing_recommendations(spark: SparkSession, d: str) -> DataFrame:
    u = usage(spark, d).where("agent = 'purchase' AND tokens_in <= 15 AND tokens_out <= 30")
    return u.groupBy("agent").agg(F.count("*").alias("calls"), F.round(F.sum("cost") * 0.8 * 30, 8).alias("monthly_savings"))


@query("WITH m AS (SELECT event_type, avg(value) AS mean, count(*) AS n FROM events GROUP BY 1), b AS (SELECT mean AS base, n AS base_n FROM m WHERE event_type = 'view') SELECT event_type, round(mean, 5) AS mean, round(mean - base, 5) AS delta, round(100 * (mean - base) / base, 4) AS delta_pct, round(n / CAST(base_n AS DOUBLE), 5) AS volume_ratio FROM m, b WHERE event_type <> 'view'")
def baseline_comparison(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "events").groupBy("event_type").agg(F.avg("value").alias("mean"), F.count("*").alias("n"))
    base = m.where("event_type = 'view'").select(F.col("mean").alias("base"), F.col("n").alias("base_n"))
    j = m.where("event_type != 'view'").crossJoin(F.broadcast(base))  # one row
    return j.select("event_type", F.round("mean", 5).alias("mean"), F.round(F.col("mean") - F.col("base"), 5).alias("delta"), F.round(100 * (F.col("mean") - F.col("base")) / F.col("base"), 4).alias("delta_pct"), F.round(F.col("n") / F.col("base_n"), 5).alias("volume_ratio"))


@query("SELECT source, round(avg(quality) / greatest(1, sum(n_chars) / 4), 12) AS token_ratio, round(sum(n_chars) FILTER (quality = 1) / greatest(1, sum(n_chars)), 6) AS information_ratio, round(count(*) FILTER (toxic = 0) / greatest(1, count(*)), 6) AS retrieval_ratio, round(avg(quality) / greatest(1e-6, count(*) * 0.0001), 6) AS agent_ratio FROM documents JOIN labels USING (doc_id) GROUP BY 1")
def efficiency_ratios(spark: SparkSession, d: str) -> DataFrame:
    j = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    chars = F.sum("n_chars")
    return j.groupBy("source").agg(
        F.round(F.avg("quality") / F.greatest(F.lit(1.0), chars / 4), 12).alias("token_ratio"), F.round(F.sum(F.when(F.col("quality") == 1, F.col("n_chars"))) / F.greatest(F.lit(1), chars), 6).alias("information_ratio"),
        F.round(F.count_if(F.col("toxic") == 0) / F.greatest(F.lit(1), F.count("*")), 6).alias("retrieval_ratio"), F.round(F.avg("quality") / F.greatest(F.lit(1e-6), F.count("*") * 0.0001), 6).alias("agent_ratio"),
    )


@query("WITH s AS (SELECT o_orderpriority, sum(o_totalprice) AS i, sum(o_totalprice) FILTER (o_orderstatus = 'F') AS o, sum(o_totalprice) FILTER (o_orderstatus = 'O') AS c, coalesce(sum(o_totalprice) FILTER (o_orderstatus NOT IN ('F', 'O')), 0) AS x FROM orders GROUP BY 1) SELECT o_orderpriority, round(i - o - c - x, 4) + 0 AS residual, abs(i - o - c - x) < 1e-3 AS conserved, round(x / i, 6) AS discarded, x / i <= 0.05 AS within_limit FROM s")
def conservation(spark: SparkSession, d: str) -> DataFrame:
    of = lambda c: F.coalesce(F.sum(F.when(c, F.col("o_totalprice"))), F.lit(0.0))
    status = F.col("o_orderstatus")
    s = table(spark, d, "orders").groupBy("o_orderpriority").agg(F.sum("o_totalprice").alias("i"), of(status == "F").alias("o"), of(status == "O").alias("c"), of(~status.isin("F", "O")).alias("x"))
    rest = F.col("i") - F.col("o") - F.col("c") - F.col("x")
    return s.select("o_orderpriority", (F.round(rest, 4) + 0.0).alias("residual"), (F.abs(rest) < 1e-3).alias("conserved"), F.round(F.col("x") / F.col("i"), 6).alias("discarded"), (F.col("x") / F.col("i") <= 0.05).alias("within_limit"))


@query("SELECT user_id, count(*) AS signals, round(avg(value), 5) AS mean, count(*) FILTER (value >= 50) AS up, count(*) FILTER (value < 50) AS down FROM events GROUP BY 1")
def feedback_statistics(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("signals"), F.round(F.avg("value"), 5).alias("mean"), F.count_if(F.col("value") >= 50).alias("up"), F.count_if(F.col("value") < 50).alias("down"))


@query("SELECT event_id, user_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 100")
def recent_signals(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").orderBy(F.desc("ts"), F.desc("event_id")).select("event_id", "user_id", "event_type").limit(100)


@query("SELECT props AS item, count(*) AS reads, round(count(*) / greatest(1, date_diff('second', min(ts), max(ts)) / 3600.0), 6) AS rate FROM events GROUP BY 1 ORDER BY reads DESC, item LIMIT 15")
def most_read_items(spark: SparkSession, d: str) -> DataFrame:
    hours = (F.unix_timestamp(F.max("ts")) - F.unix_timestamp(F.min("ts"))) / 3600.0
    return table(spark, d, "events").groupBy(F.col("props").alias("item")).agg(F.count("*").alias("reads"), F.round(F.count("*") / F.greatest(F.lit(1.0), hours), 6).alias("rate")).orderBy(F.desc("reads"), "item").limit(15)
