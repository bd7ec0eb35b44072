"""The relations that operators work on, read from tables or derived from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each line of a document: (doc_id, seq, page, type, content, x0, y0, x1, y1, section), five to a page."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("section"), F.posexplode(F.split("text", "\n")).alias("seq", "content"))
    place = (F.col("doc_id") * 37 + F.col("seq") * 11) % 60
    y0 = (F.col("seq") % 5) * 0.2
    kind = F.when(F.col("seq") == 0, "heading").when(F.col("content").contains("|"), "table").when(F.length("content") < 40, "caption").otherwise("text")
    return lines.select("doc_id", F.col("seq").cast("long").alias("seq"), (F.floor(F.col("seq") / 5) + 1).cast("int").alias("page"), kind.alias("type"), "content", (place / 100).alias("x0"), y0.alias("y0"), (place / 100 + 0.3).alias("x1"), (y0 + 0.15).alias("y1"), "section")


#: The same in SQL.
ELEMENTS_SQL = """
lines AS (SELECT doc_id, source AS section, unnest(range(0, len(p))) AS seq, unnest(p) AS content FROM (SELECT doc_id, source, string_split(text, chr(10)) AS p FROM documents)),
elements AS (SELECT doc_id, seq, CAST(seq // 5 + 1 AS INTEGER) AS page,
  CASE WHEN seq = 0 THEN 'heading' WHEN contains(content, '|') THEN 'table' WHEN length(content) < 40 THEN 'caption' ELSE 'text' END AS type, content,
  ((doc_id * 37 + seq * 11) % 60) / 100.0 AS x0, (seq % 5) * CAST(0.2 AS DOUBLE) AS y0, CAST(((doc_id * 37 + seq * 11) % 60) / 100.0 AS DOUBLE) + CAST(0.3 AS DOUBLE) AS x1, (seq % 5) * CAST(0.2 AS DOUBLE) + CAST(0.15 AS DOUBLE) AS y1, section FROM lines)"""


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as (table_id, row, col, header, value): numeric columns unpivoted, one table for each return flag."""
    wide = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("table_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row"), "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    return wide.unpivot(["table_id", "row"], ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], "header", "value")


CELLS_SQL = """
cells AS (UNPIVOT (SELECT l_returnflag AS table_id, l_orderkey * 10 + l_linenumber AS "row", l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem)
  ON l_quantity, l_extendedprice, l_discount, l_tax INTO NAME header VALUE value)"""


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst, edge_type, weight): customer to nation to region, supplier to nation; ids carry their kind."""
    nation = table(spark, sf_dir, "nation")
    kind = lambda c, p: F.concat(F.lit(p), F.col(c).cast("string"))
    up = nation.select(kind("n_nationkey", "n").alias("src"), kind("n_regionkey", "r").alias("dst"), F.lit("IN_REGION").alias("edge_type"), F.lit(1.0).alias("weight"))
    cust = table(spark, sf_dir, "customer").select(kind("c_custkey", "c").alias("src"), kind("c_nationkey", "n").alias("dst"), F.lit("LIVES_IN").alias("edge_type"), F.lit(0.5).alias("weight"))
    supp = table(spark, sf_dir, "supplier").select(kind("s_nationkey", "n").alias("src"), kind("s_suppkey", "s").alias("dst"), F.lit("HOSTS").alias("edge_type"), F.lit(2.0).alias("weight"))
    return up.unionByName(cust).unionByName(supp)


EDGES_SQL = """
edges AS (SELECT 'n' || n_nationkey AS src, 'r' || n_regionkey AS dst, 'IN_REGION' AS edge_type, CAST(1.0 AS DOUBLE) AS weight FROM nation
  UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, 'LIVES_IN', 0.5 FROM customer
  UNION ALL SELECT 'n' || s_nationkey, 's' || s_suppkey, 'HOSTS', 2.0 FROM supplier)"""


def clicks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, user_id, query_text, ts, click_ranks): a view is a query; clicks of that user and day are its clicks."""
    e = table(spark, sf_dir, "events")
    day = F.to_date("ts").alias("day")
    queries = e.where("event_type = 'view'").select(F.col("event_id").alias("query_id"), "user_id", F.col("props").alias("query_text"), "ts", day)
    clicked = e.where("event_type = 'click'").groupBy("user_id", day).agg(F.sort_array(F.collect_list((F.col("event_id") % 10).cast("int"))).alias("click_ranks"))
    return queries.join(clicked, ["user_id", "day"], "left").select("query_id", "user_id", "query_text", "ts", F.coalesce("click_ranks", F.array().cast("array<int>")).alias("click_ranks"))


CLICKS_SQL = """
clicked AS (SELECT user_id, CAST(ts AS DATE) AS day, list_sort(list(CAST(event_id % 10 AS INTEGER))) AS ranks FROM events WHERE event_type = 'click' GROUP BY 1, 2),
clicks AS (SELECT event_id AS query_id, q.user_id, props AS query_text, ts, coalesce(ranks, []) AS click_ranks
  FROM (SELECT * FROM events WHERE event_type = 'view') q LEFT JOIN clicked c ON q.user_id = c.user_id AND CAST(q.ts AS DATE) = c.day)"""
