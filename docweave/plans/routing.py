"""Questions from orders' priorities and texts, memory items from events, roles from nations, decisions from parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.operators import routing as R
from docweave.plans.base import query
from docweave.sources.relations import table

_QUESTIONS = ["What is the total price of order ", "Who wrote invoice ", "Explain the meaning of clause ", "Which rows are below header ", "Show duplicate pages of ", "When was it due in fiscal year ", "Hello there", "Which path does it connect to"]
_CASES = " ".join(f"WHEN {i} THEN '{q}'" for i, q in enumerate(_QUESTIONS))
_TEXT = f"CASE o_orderkey % 8 {_CASES} END || CASE WHEN o_orderkey % 8 IN (0, 1) THEN CAST(o_orderkey AS VARCHAR) ELSE '' END"


def _kind(pick: int, default: object) -> str:
    quote = lambda v: f"'{v}'" if isinstance(v, str) else f"CAST({v} AS DOUBLE)"
    return "CASE " + " ".join(f"WHEN regexp_matches(q, '{t[1]}') THEN {quote((t[0], t[2], t[3])[pick])}" for t in R.QUESTION_TYPES) + f" ELSE {quote(default)} END"


@query(f"SELECT o_orderkey, {_kind(0, R.UNKNOWN[0])} AS type, {_kind(1, R.UNKNOWN[1])} AS confidence, {_kind(2, R.UNKNOWN[2])} AS semantic_weight FROM (SELECT o_orderkey, lower(trim({_TEXT})) AS q FROM orders)")
def question_types(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("o_orderkey") % 8
    text = F.get(F.array(*map(F.lit, _QUESTIONS)), i.cast("int"))
    text = F.concat(text, F.when(i.isin(0, 1), F.col("o_orderkey").cast("string")).otherwise(""))
    return table(spark, d, "orders").select("o_orderkey", R.question_type(text).alias("t")).select("o_orderkey", "t.*")


_ITEMS = "items AS (SELECT user_id AS item, CAST(user_id % 6 AS INTEGER) AS level, count(*) AS frequency, 2592000 - CAST(floor(epoch(max(ts)) - epoch(TIMESTAMP '2024-01-01')) AS BIGINT) AS recency, (user_id % 10) / CAST(10 AS DOUBLE) AS importance, CAST(sum(length(props)) AS BIGINT) AS bytes FROM events GROUP BY 1)"
_KEEP = "0.4 / (1 + recency) + 0.4 * least(frequency / 100, 1) + 0.2 * importance"


def items(spark: SparkSession, d: str) -> DataFrame:
    """A memory item for each user: uses, seconds since the last one at the month's end, importance, bytes, tier."""
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    last = F.unix_timestamp(F.date_trunc("second", F.max("ts"))) - F.unix_timestamp(F.lit("2024-01-01").cast("timestamp"))
    g = e.groupBy(F.col("user_id").alias("item")).agg(F.count("*").alias("frequency"), (F.lit(2592000) - last).alias("recency"), F.sum(F.length("props")).alias("bytes"))
    return g.select("item", (F.col("item") % 6).cast("int").alias("level"), "frequency", "recency", ((F.col("item") % 10) / 10).alias("importance"), "bytes")


@query(f"WITH {_ITEMS} SELECT item, level, round({_KEEP}, 9) AS keep_score, round(0.4 * least(frequency, 1) + 0.4 * importance + 0.2 / (1 + recency), 9) AS promotion_score, 0.4 * least(frequency, 1) + 0.4 * importance + 0.2 / (1 + recency) >= 0.5 AND level < 5 AS promote FROM items")
def memory_scores(spark: SparkSession, d: str) -> DataFrame:
    r, f, i = F.col("recency"), F.col("frequency"), F.col("importance")
    p = R.promotion_score(r, f, i)
    return items(spark, d).select("item", "level", F.round(R.keep_score(r, f, i), 9).alias("keep_score"), F.round(p, 9).alias("promotion_score"), ((p >= 0.5) & (F.col("level") < 5)).alias("promote"))


@query(f"WITH {_ITEMS}, s AS (SELECT *, round({_KEEP}, 9) AS score FROM items), b AS (SELECT *, coalesce(sum(bytes) OVER (PARTITION BY level ORDER BY score, item ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM s) SELECT level, item, score FROM b WHERE before < 2000")
def memory_evictions(spark: SparkSession, d: str) -> DataFrame:
    s = items(spark, d).withColumn("score", F.round(R.keep_score(F.col("recency"), F.col("frequency"), F.col("importance")), 9))
    return R.evicted(s, "level", "item", "bytes", "score", 2000)


@query(f"WITH {_ITEMS} SELECT level, count(*) AS items, CAST(sum(bytes) AS BIGINT) AS bytes, CAST(count(*) FILTER (recency > 86400) AS BIGINT) AS cold FROM items GROUP BY 1")
def memory_tiers(spark: SparkSession, d: str) -> DataFrame:
    return items(spark, d).groupBy("level").agg(F.count("*").alias("items"), F.sum("bytes").alias("bytes"), F.count_if(F.col("recency") > 86400).alias("cold"))


@query("SELECT doc_id, round((0.4 * (doc_id % 10) / 10 + 0.3 * (doc_id % 7) / 7 + 0.3 * (doc_id % 5) / 5) / ln(2 + n_chars / 4 / 100), 9) AS priority FROM documents ORDER BY priority DESC, doc_id LIMIT 50")
def export_priorities(spark: SparkSession, d: str) -> DataFrame:
    part = lambda n: (F.col("doc_id") % n) / n
    p = R.priority(part(10), part(7), part(5), F.col("n_chars") / 4)
    return table(spark, d, "documents").select("doc_id", F.round(p, 9).alias("priority")).orderBy(F.desc("priority"), "doc_id").limit(50)


@query("WITH RECURSIVE p AS (SELECT n_nationkey AS child, CAST(n_nationkey // 2 AS INTEGER) AS parent FROM nation WHERE n_nationkey > 0), c AS (SELECT n_nationkey AS role, n_nationkey AS ancestor FROM nation UNION SELECT c.role, p.parent FROM c JOIN p ON c.ancestor = p.child) SELECT role, ancestor FROM c")
def role_closure(spark: SparkSession, d: str) -> DataFrame:
    """A binary hierarchy of nations: each inherits from the one of half its number."""
    p = table(spark, d, "nation").where("n_nationkey > 0").select(F.col("n_nationkey").alias("child"), F.floor(F.col("n_nationkey") / 2).cast("int").alias("parent"))
    return R.closure(p, "child", "parent", 6)


@query("WITH m AS (SELECT l_suppkey AS series, avg(l_extendedprice) AS mean, stddev_pop(l_extendedprice) AS std, count(*) AS n FROM lineitem GROUP BY 1) SELECT l_orderkey, l_linenumber, round((l_extendedprice - mean) / std, 4) AS z FROM lineitem JOIN m ON l_suppkey = series WHERE n >= 3 AND std > 0 AND abs((l_extendedprice - mean) / std) > 1.7")
def price_anomalies(spark: SparkSession, d: str) -> DataFrame:
    return R.z_anomalies(table(spark, d, "lineitem"), "l_suppkey", "l_extendedprice", 1.7).select("l_orderkey", "l_linenumber", F.round("z", 4).alias("z"))


@query("WITH j AS (SELECT a.r_regionkey AS i, (a.r_regionkey + 1.0) / (b.r_regionkey + 1.0) AS v FROM region a, region b), g AS (SELECT i, exp(avg(ln(v))) AS g FROM j GROUP BY 1) SELECT i, round(g / sum(g) OVER (), 9) AS weight FROM g")
def pairwise_weights(spark: SparkSession, d: str) -> DataFrame:
    """Five criteria, each judged against each: a table of fixed size."""
    r = table(spark, d, "region").select("r_regionkey")
    n = [x.r_regionkey for x in r.limit(101).collect()]
    if len(n) > 100:
        raise ValueError("over 100 criteria")
    j = r.select(F.col("r_regionkey").alias("i"), F.explode(F.array(*map(F.lit, n))).alias("j")).withColumn("v", (F.col("i") + 1) / (F.col("j") + 1))
    return R.geometric_weights(j, "i", "v").withColumn("weight", F.round("weight", 9))


@query("WITH e AS (SELECT user_id AS claim, 0.2 AS prior, CASE event_type WHEN 'purchase' THEN 1.5 WHEN 'error' THEN 0.7 ELSE 1.02 END AS ratio FROM events), s AS (SELECT claim, 0.25 * exp(sum(ln(ratio))) AS odds FROM e GROUP BY 1) SELECT claim, round(odds / (1 + odds), 6) AS belief FROM s")
def beliefs(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("event_type")
    e = table(spark, d, "events").select(F.col("user_id").alias("claim"), F.lit(0.2).alias("prior"), F.when(t == "purchase", 1.5).when(t == "error", 0.7).otherwise(1.02).alias("ratio"))
    return R.posterior(e, "claim", "prior", "ratio").withColumn("belief", F.round("belief", 6))


@query("SELECT c_custkey, CASE WHEN h % 7 < 2 THEN 2 WHEN h % 5 < 2 THEN 1 WHEN h % 3 < 1 THEN 0 ELSE 0 END AS shard FROM (SELECT c_custkey, CAST('0x' || substr(md5(CAST(c_custkey AS VARCHAR)), 1, 8) AS BIGINT) AS h FROM customer)")
def shards(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", R.shard(F.col("c_custkey"), [3, 5, 7], [1, 2, 2]).alias("shard"))


@query("SELECT s_nationkey AS region, arg_min(s_suppkey, (s_acctbal, s_suppkey)) AS cheapest, count(*) AS healthy FROM supplier WHERE s_acctbal > 0 GROUP BY 1")
def endpoint_choice(spark: SparkSession, d: str) -> DataFrame:
    """The cheapest healthy endpoint of each region."""
    return table(spark, d, "supplier").where("s_acctbal > 0").groupBy(F.col("s_nationkey").alias("region")).agg(F.min_by("s_suppkey", F.struct("s_acctbal", "s_suppkey")).alias("cheapest"), F.count("*").alias("healthy"))


@query("SELECT p_partkey, round(ln(1 + p_retailprice), 6) AS log_utility, round(1 - exp(-p_retailprice / 1000), 6) AS exponential_utility, round(least(30, 0.5 * pow(2, p_size % 8)), 4) AS backoff FROM part")
def utilities(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("p_retailprice")
    return table(spark, d, "part").select("p_partkey", F.round(F.log(1 + v), 6).alias("log_utility"), F.round(1 - F.exp(-v / 1000), 6).alias("exponential_utility"), F.round(F.least(F.lit(30.0), 0.5 * F.pow(F.lit(2.0), F.col("p_size") % 8)), 4).alias("backoff"))
