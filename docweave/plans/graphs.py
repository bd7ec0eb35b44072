"""The graph of customers, nations, regions and suppliers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.operators import graphs as G
from docweave.plans.base import query
from docweave.sources.relations import EDGES_SQL, edges

_NODES = "nodes AS (SELECT src AS node FROM edges UNION SELECT dst FROM edges), n AS (SELECT count(*) AS n FROM nodes)"


@query(f"WITH {EDGES_SQL}, {_NODES}, d AS (SELECT node, sum(o) AS out_degree, sum(i) AS in_degree FROM (SELECT src AS node, 1 AS o, 0 AS i FROM edges UNION ALL SELECT dst, 0, 1 FROM edges) GROUP BY 1) SELECT node, CAST(out_degree AS BIGINT) AS out_degree, CAST(in_degree AS BIGINT) AS in_degree, round((out_degree + in_degree) / (n - 1), 6) AS centrality FROM d, n")
def degree_centrality(spark: SparkSession, d: str) -> DataFrame:
    return G.degrees(edges(spark, d)).withColumn("centrality", F.round("centrality", 6))


@query(f"WITH {EDGES_SQL} SELECT edge_type, count(*) AS n, round(sum(weight), 4) AS weight FROM edges GROUP BY 1")
def edge_types(spark: SparkSession, d: str) -> DataFrame:
    return edges(spark, d).groupBy("edge_type").agg(F.count("*").alias("n"), F.round(F.sum("weight"), 4).alias("weight"))


@query(f"WITH {EDGES_SQL}, {_NODES} SELECT substr(node, 1, 1) AS node_type, count(*) AS n FROM nodes GROUP BY 1")
def node_types(spark: SparkSession, d: str) -> DataFrame:
    return G.nodes(edges(spark, d)).groupBy(F.substring("node", 1, 1).alias("node_type")).agg(F.count("*").alias("n"))


def _ranks(weight: str, spread: bool, teleport: str) -> str:
    """Ten rounds of PageRank in a recursive query over lists of (node, rank) states."""
    return f"""WITH {EDGES_SQL}, {_NODES}, e AS (SELECT src, dst, sum({weight}) AS w FROM edges GROUP BY 1, 2), share AS (SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS p FROM e), s AS (SELECT node, {teleport} AS s FROM nodes, n),
r0 AS (SELECT node, s AS rank FROM s)""" + "".join(
        f""", d{i} AS (SELECT {'coalesce(sum(rank), 0)' if spread else 'coalesce(sum(0), 0)'} AS lost FROM r{i - 1} WHERE node NOT IN (SELECT src FROM share)), g{i} AS (SELECT dst AS node, sum(rank * p) AS got FROM r{i - 1} JOIN share ON node = src GROUP BY 1), r{i} AS (SELECT s.node, 0.15 * s + 0.85 * (coalesce(got, 0) + lost * s) AS rank FROM s LEFT JOIN g{i} USING (node), d{i})"""
        for i in range(1, 6)
    ) + " SELECT node, round(rank, 9) AS rank FROM r5"


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("rank", F.round("rank", 9))


@query(_ranks("weight", True, "CAST(1.0 AS DOUBLE) / n"))
def pagerank(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(G.pagerank(edges(spark, d), 5, weighted=True))


@query(_ranks("1", False, "CAST(1.0 AS DOUBLE) / n"))
def pagerank_unweighted(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(G.pagerank(edges(spark, d), 5, dangling="lost"))


@query(_ranks("1", False, "CASE WHEN node = 'c1' THEN CAST(1.0 AS DOUBLE) ELSE 0 END"))
def pagerank_from_seed(spark: SparkSession, d: str) -> DataFrame:
    seed = G.nodes(edges(spark, d)).where("node = 'c1'")
    return _rounded(G.pagerank(edges(spark, d), 5, dangling="lost", seeds=seed))


@query(f"WITH RECURSIVE {EDGES_SQL}, b AS (SELECT 'c1' AS node, 0 AS depth UNION SELECT dst, depth + 1 FROM b JOIN edges ON src = node WHERE depth < 3) SELECT node, CAST(min(depth) AS INTEGER) AS depth, round(1 / (1 + min(depth)), 6) AS score FROM b GROUP BY 1")
def breadth_first(spark: SparkSession, d: str) -> DataFrame:
    b = G.breadth_first(edges(spark, d), spark.createDataFrame([("c1",)], "node string"), 3)
    return b.select("node", "depth", F.round(1 / (1 + F.col("depth")), 6).alias("score"))


@query(f"WITH RECURSIVE {EDGES_SQL}, u AS (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges), b AS (SELECT 'r0' AS node, 0 AS depth UNION SELECT dst, depth + 1 FROM b JOIN u ON src = node WHERE depth < 2) SELECT node, CAST(min(depth) AS INTEGER) AS depth FROM b GROUP BY 1")
def ego_network(spark: SparkSession, d: str) -> DataFrame:
    return G.breadth_first(edges(spark, d), spark.createDataFrame([("r0",)], "node string"), 2, directed=False)


@query(f"WITH RECURSIVE {EDGES_SQL}, u AS (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges), r AS (SELECT src AS node, src AS c FROM u UNION SELECT u.dst, r.c FROM r JOIN u ON u.src = r.node WHERE u.dst <> r.c) SELECT node, min(c) AS component FROM r GROUP BY 1")
def connected_components(spark: SparkSession, d: str) -> DataFrame:
    return G.components(edges(spark, d))


@query(f"WITH RECURSIVE {EDGES_SQL}, p AS (SELECT [src, dst] AS path, weight, dst AS last FROM edges WHERE src = 'c1' UNION ALL SELECT list_append(path, dst), p.weight + e.weight, dst FROM p JOIN edges e ON e.src = p.last WHERE NOT list_contains(path, dst) AND len(path) < 4) SELECT array_to_string(path, '>') AS path, CAST(len(path) - 1 AS INTEGER) AS length, round(weight, 4) AS weight FROM p WHERE last = (SELECT dst FROM edges WHERE src = (SELECT dst FROM edges WHERE src = 'c1' LIMIT 1) AND edge_type = 'IN_REGION')")
def simple_paths(spark: SparkSession, d: str) -> DataFrame:
    e = edges(spark, d)
    region = e.where("src = 'c1'").select(F.col("dst").alias("src")).join(e.where("edge_type = 'IN_REGION'"), "src").select("dst").first()
    return G.paths(e, "c1", region[0] if region else "", 3).select(F.array_join("path", ">").alias("path"), "length", F.round("weight", 4).alias("weight"))


#: Parts and suppliers of orders give a graph with cycles.
_CO = "und AS (SELECT DISTINCT least(a, b) AS a, greatest(a, b) AS b FROM (SELECT o_custkey % 40 AS a, (o_orderkey // 4) % 40 AS b FROM orders) WHERE a <> b)"


@query(f"WITH {_CO}, t AS (SELECT x.a AS p, x.b AS q, y.b AS r FROM und x JOIN und y ON x.b = y.a JOIN und z ON z.a = x.a AND z.b = y.b) SELECT node, count(*) AS triangles FROM (SELECT unnest([p, q, r]) AS node FROM t) GROUP BY 1")
def triangle_counts(spark: SparkSession, d: str) -> DataFrame:
    from docweave.sources.relations import table

    o = table(spark, d, "orders").select((F.col("o_custkey") % 40).alias("src"), (F.floor(F.col("o_orderkey") / 4) % 40).alias("dst"))
    return G.triangles(o)
