"""Tensors of orders, signals of events, choice of documents under a budget."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.operators import numeric as N
from docweave.plans.base import query
from docweave.sources.relations import table

_T = "t AS (SELECT l_returnflag AS i, l_linestatus AS j, l_linenumber AS k, sum(l_quantity) AS value FROM lineitem GROUP BY 1, 2, 3)"


def tensor(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("i"), F.col("l_linestatus").alias("j"), F.col("l_linenumber").alias("k")).agg(F.sum("l_quantity").alias("value"))


@query(f"WITH {_T} SELECT i, j, round(sum(value), 4) AS total, round(sum(value) / 7, 4) AS mean FROM t GROUP BY 1, 2")
def tensor_marginals(spark: SparkSession, d: str) -> DataFrame:
    t = tensor(spark, d)
    return N.mode_sum(t, ["i", "j"]).select("i", "j", F.round("value", 4).alias("total"), F.round(F.col("value") / 7, 4).alias("mean"))


@query(f"WITH {_T} SELECT a.i AS i, b.i AS i2, round(sum(a.value * b.value), 2) AS value FROM t a JOIN t b ON a.k = b.k AND a.j = b.j AND a.j = 'O' GROUP BY 1, 2")
def tensor_contraction(spark: SparkSession, d: str) -> DataFrame:
    t = tensor(spark, d).where("j = 'O'")
    return N.contract(t, t.withColumnRenamed("i", "i2"), "k", ["i"], ["i2"]).withColumn("value", F.round("value", 2))


@query(f"WITH {_T} SELECT round(sqrt(sum(value * value)), 4) AS frobenius, round(sum(abs(value)), 4) AS l1, round(max(abs(value)), 4) AS l_inf, count(*) AS cells FROM t")
def tensor_norms(spark: SparkSession, d: str) -> DataFrame:
    return N.norms(tensor(spark, d)).select(*(F.round(c, 4).alias(c) for c in ("frobenius", "l1", "l_inf")), "cells")


_S = "s AS (SELECT event_type, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INTEGER) AS t, sum(value) AS v FROM events GROUP BY 1, 2)"


def signal(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("event_type", F.date_diff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).alias("t")).agg(F.sum("value").alias("v"))


@query(f"WITH {_S} SELECT event_type, CAST(t // 2 AS BIGINT) AS k, round((arg_min(v, t) + arg_max(v, t)) / sqrt(2), 4) AS approximation, round((arg_min(v, t) - arg_max(v, t)) / sqrt(2), 4) AS detail FROM s GROUP BY 1, 2")
def haar_wavelet(spark: SparkSession, d: str) -> DataFrame:
    h = N.haar(signal(spark, d), ["event_type"], "t", "v")
    return h.select("event_type", "k", F.round("approximation", 4).alias("approximation"), F.round("detail", 4).alias("detail"))


@query(f"WITH {_S} SELECT event_type, CAST(k AS INTEGER) AS k, round(sum(v * cos(-2 * pi() * k * t / 30)), 3) + 0.0 AS re, round(sum(v * sin(-2 * pi() * k * t / 30)), 3) + 0.0 AS im FROM s, range(0, 30) r(k) GROUP BY 1, 2")
def fourier(spark: SparkSession, d: str) -> DataFrame:
    f = N.dft(signal(spark, d), ["event_type"], "t", "v", 30)
    return f.select("event_type", "k", (F.round("re", 3) + F.lit(0.0)).alias("re"), (F.round("im", 3) + F.lit(0.0)).alias("im"))


@query("WITH j AS (SELECT c_mktsegment AS a, c_nationkey % 5 AS b, count(*) AS n FROM customer GROUP BY 1, 2), t AS (SELECT sum(n) AS total FROM j), x AS (SELECT a, sum(n) AS na FROM j GROUP BY 1), y AS (SELECT b, sum(n) AS nb FROM j GROUP BY 1) SELECT round(sum(n / total * log2(n * total / (na * nb))), 9) AS bits FROM j JOIN x USING (a) JOIN y USING (b), t")
def mutual_information(spark: SparkSession, d: str) -> DataFrame:
    j = table(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("a"), (F.col("c_nationkey") % 5).alias("b")).agg(F.count("*").alias("n"))
    return N.mutual_information(j, "a", "b", "n").select(F.round("bits", 9).alias("bits"))


@query("SELECT p_partkey, p_retailprice, p_size FROM part p WHERE NOT EXISTS (SELECT 1 FROM part q WHERE q.p_retailprice >= p.p_retailprice AND q.p_size <= p.p_size AND (q.p_retailprice > p.p_retailprice OR q.p_size < p.p_size))")
def pareto_front(spark: SparkSession, d: str) -> DataFrame:
    return N.skyline(table(spark, d, "part"), "p_partkey", "p_retailprice", "p_size")


@query("SELECT source, doc_id, CAST(used AS BIGINT) AS used FROM (SELECT source, doc_id, sum(CAST(ceil(n_chars / 4.0) AS BIGINT)) OVER (PARTITION BY source ORDER BY doc_id) AS used FROM documents) WHERE used <= 4000")
def budget_fit(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "documents").withColumn("tokens", F.ceil(F.col("n_chars") / F.lit(4)))
    return N.fit_in_budget(items, "source", [F.asc("doc_id")], "tokens", 4000).select("source", "doc_id", "used")


def candidates(spark: SparkSession, d: str) -> DataFrame:
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels").groupBy("doc_id").agg(F.max("quality").alias("q"))
    return docs.join(labels, "doc_id", "left").select("source", "doc_id", F.ceil(F.col("n_chars") / F.lit(40)).cast("long").alias("size"), (F.coalesce(F.col("q").cast("double"), F.lit(0.5)) + (F.col("doc_id") % 10) / 100).alias("value"))


@query()
def knapsack_greedy(spark: SparkSession, d: str) -> DataFrame:
    """Documents of each source by value for size within a budget; tests hold it to the definition."""
    return N.knapsack(candidates(spark, d), "source", "doc_id", 400, exact=False)


@query()
def knapsack_exact(spark: SparkSession, d: str) -> DataFrame:
    """The best value within the budget; tests compare with all subsets of small lists."""
    return N.knapsack(candidates(spark, d), "source", "doc_id", 400, exact=True)


@query()
def laplacian_spectrum(spark: SparkSession, d: str) -> DataFrame:
    """Least eigenvalues of each region's graph of nations and suppliers."""
    n = table(spark, d, "nation")
    s = table(spark, d, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey"))
    e = s.select(F.col("n_regionkey").alias("region"), F.concat(F.lit("n"), "n_nationkey").alias("src"), F.concat(F.lit("s"), "s_suppkey").alias("dst"), F.lit(1.0).alias("weight"))
    up = n.select(F.col("n_regionkey").alias("region"), F.concat(F.lit("r"), "n_regionkey").alias("src"), F.concat(F.lit("n"), "n_nationkey").alias("dst"), F.lit(1.0).alias("weight"))
    return N.spectrum(e.unionByName(up), "region", 5)


@query("WITH f AS (SELECT doc_id, n_chars AS n, log2(1 + n_chars) AS h FROM documents) SELECT doc_id, round(h, 6) AS entropy, round(h / max(h) OVER (), 6) AS relevance, round(0.5 * (0.6 * h + 0.4 * h * h / max(h) OVER ()) + 0.5 * h * h / max(h) OVER (), 6) AS energy, round(n / (1 + abs(doc_id - 500.0) * abs(doc_id - 500.0)), 6) AS gravity FROM f")
def information_energy(spark: SparkSession, d: str) -> DataFrame:
    """Energy from an entropy and its share of the greatest, and a gravity that falls with squared distance."""
    f = table(spark, d, "documents").select("doc_id", F.col("n_chars").alias("n"), F.log2(1 + F.col("n_chars")).alias("h"))
    top = f.agg(F.max("h").alias("top"))
    f = f.join(F.broadcast(top)).withColumn("r", F.col("h") / F.col("top"))
    off = F.abs(F.col("doc_id") - 500.0)
    return f.select("doc_id", F.round("h", 6).alias("entropy"), F.round("r", 6).alias("relevance"), F.round(0.5 * (0.6 * F.col("h") + 0.4 * F.col("h") * F.col("r")) + 0.5 * F.col("h") * F.col("r"), 6).alias("energy"), F.round(F.col("n") / (1 + off * off), 6).alias("gravity"))
