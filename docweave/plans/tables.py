"""Cells of lineitem and series of orders: statistics, growth, correlation, table text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.functions import text as T
from docweave.operators import tables as Ta
from docweave.plans.base import query
from docweave.sources.relations import CELLS_SQL, cells, table

COLUMNS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


_STATS = "round(sum(value), 4) AS sum, round(avg(value), 4) AS mean, round(min(value), 4) AS min, round(max(value), 4) AS max, round(median(value), 4) AS median, round(coalesce(stddev_samp(value), 0), 4) AS std, round(coalesce(var_samp(value), 0), 4) AS var, count(value) AS count"


@query(f"WITH {CELLS_SQL} SELECT table_id, header, {_STATS} FROM cells GROUP BY 1, 2")
def column_statistics(spark: SparkSession, d: str) -> DataFrame:
    return rounded(Ta.column_statistics(cells(spark, d), ["table_id", "header"]))


@query(f'WITH {CELLS_SQL} SELECT table_id, "row", round(sum(value), 6) AS sum, round(avg(value), 6) AS mean, round(min(value), 6) AS min, round(max(value), 6) AS max FROM cells GROUP BY 1, 2')
def row_statistics(spark: SparkSession, d: str) -> DataFrame:
    return rounded(cells(spark, d).groupBy("table_id", "row").agg(F.sum("value").alias("sum"), F.avg("value").alias("mean"), F.min("value").alias("min"), F.max("value").alias("max")), 6)


@query(f"WITH {CELLS_SQL} SELECT table_id, header, round(quantile_cont(value, 0.25), 4) AS q25, round(quantile_cont(value, 0.5), 4) AS q50, round(quantile_cont(value, 0.9), 4) AS q90, round(quantile_cont(value, 0.99), 4) AS q99 FROM cells GROUP BY 1, 2")
def column_quantiles(spark: SparkSession, d: str) -> DataFrame:
    return rounded(Ta.quantiles(cells(spark, d), ["table_id", "header"], [0.25, 0.5, 0.9, 0.99]))


@query(f'WITH {CELLS_SQL} SELECT table_id, count(*) AS cells, count(DISTINCT "row") AS rows, count(DISTINCT header) AS columns, count(*) FILTER (value IS NULL) AS missing, round(count(value) / count(*), 4) AS completeness FROM cells GROUP BY 1')
def table_statistics(spark: SparkSession, d: str) -> DataFrame:
    return rounded(cells(spark, d).groupBy("table_id").agg(F.count("*").alias("cells"), F.count_distinct("row").alias("rows"), F.count_distinct("header").alias("columns"), F.count_if(F.col("value").isNull()).alias("missing"), (F.count("value") / F.count("*")).alias("completeness")))


#: Monthly order values by priority: rows of a series.
_SERIES = "series AS (SELECT o_orderpriority AS series, CAST(date_diff('month', DATE '1990-01-01', CAST(o_orderdate AS DATE)) AS INTEGER) AS row, sum(o_totalprice) AS value FROM orders GROUP BY 1, 2)"


def series(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    month = ((F.year("o_orderdate") - 1990) * 12 + F.month("o_orderdate") - 1).alias("row")
    return o.groupBy(F.col("o_orderpriority").alias("series"), month).agg(F.sum("o_totalprice").alias("value"))


@query(f"""WITH {_SERIES}, g AS (SELECT series, arg_min(value, row) AS first, arg_max(value, row) AS last, count(*) AS n FROM series GROUP BY 1)
SELECT series, round(first, 4) AS first, round(last, 4) AS last, round(last - first, 4) AS change, round((last - first) / abs(first), 6) AS rate, round(100 * (last - first) / abs(first), 4) AS percent, round(pow(last / first, 1 / (n - 1)) - 1, 6) AS cagr FROM g""")
def growth_summary(spark: SparkSession, d: str) -> DataFrame:
    g = Ta.growth(series(spark, d), ["series"])
    return g.select("series", *(F.round(c, 6 if c in ("rate", "cagr") else 4).alias(c) for c in ("first", "last", "change", "rate", "percent", "cagr")))


_RATES = f"WITH {_SERIES}, b AS (SELECT *, lag(value) OVER (PARTITION BY series ORDER BY row) AS before FROM series), rates AS (SELECT series, row, (value - before) / abs(before) AS rate FROM b WHERE before <> 0)"


@query(f"{_RATES} SELECT series, row, round(rate, 6) AS rate FROM rates")
def period_growth_rates(spark: SparkSession, d: str) -> DataFrame:
    return Ta.period_growth(series(spark, d), ["series"]).withColumn("rate", F.round("rate", 6))


@query(f"{_RATES} SELECT series, round(avg(rate), 6) AS mean_rate, CASE WHEN avg(rate) > 0.05 THEN 'increasing' WHEN avg(rate) < -0.05 THEN 'decreasing' ELSE 'stable' END AS trend FROM rates GROUP BY 1")
def growth_trend(spark: SparkSession, d: str) -> DataFrame:
    return Ta.trend(Ta.period_growth(series(spark, d), ["series"]), ["series"]).withColumn("mean_rate", F.round("mean_rate", 6))


_PAIRS = [(a, b) for i, a in enumerate(COLUMNS) for b in COLUMNS[i + 1 :]]


@query(" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS pearson, round(covar_samp({a}, {b}), 4) AS covariance FROM lineitem" for a, b in _PAIRS))
def correlation_matrix(spark: SparkSession, d: str) -> DataFrame:
    c = Ta.correlations(table(spark, d, "lineitem"), COLUMNS)
    return c.select("a", "b", F.round("pearson", 6).alias("pearson"), F.round("covariance", 4).alias("covariance"))


@query(f"SELECT * FROM ({' UNION ALL '.join(f'SELECT {chr(39)}{a}{chr(39)} AS a, {chr(39)}{b}{chr(39)} AS b, round(corr({a}, {b}), 6) AS pearson FROM lineitem' for a, b in _PAIRS)}) WHERE abs(pearson) >= 0.01")
def correlated_pairs(spark: SparkSession, d: str) -> DataFrame:
    c = Ta.correlations(table(spark, d, "lineitem"), COLUMNS)
    return c.select("a", "b", F.round("pearson", 6).alias("pearson")).where("abs(pearson) >= 0.01")


@query("WITH r AS (SELECT rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2 AS x, rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2 AS y FROM lineitem) SELECT round(corr(x, y), 6) AS spearman FROM r")
def spearman_quantity_price(spark: SparkSession, d: str) -> DataFrame:
    return Ta.spearman(table(spark, d, "lineitem"), "l_quantity", "l_extendedprice").withColumn("spearman", F.round("spearman", 6))


@query("SELECT n_regionkey AS region, '| n_nationkey | n_name |' || chr(10) || '|---|---|' || chr(10) || string_agg('| ' || n_nationkey || ' | ' || n_name || ' |', chr(10) ORDER BY n_nationkey) AS markdown FROM nation GROUP BY 1")
def nations_markdown(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").withColumn("region", F.col("n_regionkey"))
    return Ta.markdown(n, "region", "n_nationkey", ["n_nationkey", "n_name"])


@query("SELECT n_regionkey AS region, CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS INTEGER) AS row, CAST(n_nationkey AS VARCHAR) AS key, n_name AS name FROM nation")
def markdown_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Tables written as markdown and read back: header, separator and cells."""
    m = nations_markdown(spark, d).select("region", F.posexplode(Ta.parsed_markdown(F.col("markdown"))).alias("row", "cells")).where("row > 0")
    return m.select("region", "row", F.get("cells", F.lit(0)).alias("key"), F.get("cells", F.lit(1)).alias("name"))


_RAW = "CASE p_partkey % 5 WHEN 0 THEN '$' || CAST(p_retailprice AS VARCHAR) WHEN 1 THEN p_size || '%' WHEN 2 THEN p_size || 'K' WHEN 3 THEN p_size || '.5M' ELSE p_brand END"


@query("SELECT p_partkey, round(CASE p_partkey % 5 WHEN 0 THEN p_retailprice WHEN 1 THEN p_size / 100.0 WHEN 2 THEN p_size * 1000.0 WHEN 3 THEN (p_size + 0.5) * 1000000.0 END, 4) AS value FROM part")
def numeric_parse(spark: SparkSession, d: str) -> DataFrame:
    """Currency, percent and magnitude suffixes; what is no number is null."""
    p, s = F.col("p_partkey") % 5, F.col("p_size").cast("string")
    raw = F.when(p == 0, F.concat(F.lit("$"), F.format_number("p_retailprice", 4))).when(p == 1, F.concat(s, F.lit("%"))).when(p == 2, F.concat(s, F.lit("K"))).when(p == 3, F.concat(s, F.lit(".5M"))).otherwise(F.col("p_brand"))
    return table(spark, d, "part").select("p_partkey", F.round(T.try_numeric(raw), 4).alias("value"))
