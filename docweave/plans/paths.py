"""Paths and centralities of the graph of customers, nations, regions and suppliers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.operators import graphs as G
from docweave.operators import paths as P
from docweave.plans.base import query
from docweave.plans.graphs import connected_components  # noqa: F401  its SQL is used here
from docweave.plans.base import ORACLE_SQL
from docweave.sources.relations import EDGES_SQL, edges

_E = f"WITH RECURSIVE {EDGES_SQL}"
_FROM = "c1"
_PATHS = """p AS (SELECT 'c1' AS node, CAST(0 AS DOUBLE) AS cost, ['c1'] AS path UNION ALL SELECT dst, round(cost + {w}, 9), list_append(path, dst) FROM p JOIN edges ON src = node WHERE NOT list_contains(path, dst))"""


def one(spark: SparkSession, node: str = _FROM) -> DataFrame:
    return spark.createDataFrame([(node,)], "node string")


@query(f"{_E}, {_PATHS.format(w='1')} SELECT node, CAST(min(cost) AS INTEGER) AS depth, round(1 / (1 + min(cost)), 6) AS score FROM p GROUP BY 1 HAVING min(cost) <= 3")
def search_by_hops(spark: SparkSession, d: str) -> DataFrame:
    h = P.hops(edges(spark, d), one(spark), 3)
    return h.select("node", F.col("hops").alias("depth"), F.round(1 / (1 + F.col("hops")), 6).alias("score"))


def _shortest(weighted: bool):
    def run(spark: SparkSession, d: str) -> DataFrame:
        p = P.shortest_paths(edges(spark, d), _FROM, weighted)
        return p.select("node", F.round("cost", 6).alias("cost"), F.array_join("path", ">").alias("path"))

    run.__name__ = "weighted_shortest_paths" if weighted else "shortest_paths"
    return run


for _weighted, _w in ((False, "1"), (True, "weight")):
    query(f"{_E}, {_PATHS.format(w=_w)} SELECT node, round(min(cost), 6) AS cost, array_to_string(arg_min(path, (cost, path)), '>') AS path FROM p GROUP BY 1")(_shortest(_weighted))


@query(f"{_E}, {_PATHS.format(w='1')} SELECT edge_type, count(*) AS n, round(sum(weight), 4) AS weight FROM edges WHERE src IN (SELECT node FROM p WHERE cost < 3) GROUP BY 1")
def relationships_by_type(spark: SparkSession, d: str) -> DataFrame:
    return P.relationships(edges(spark, d), one(spark), 3).withColumn("weight", F.round("weight", 4))


@query(f"WITH {EDGES_SQL} SELECT dst AS neighbour, 'out' AS direction FROM edges WHERE src = 'n3' UNION SELECT src, 'in' FROM edges WHERE dst = 'n3' AND src NOT IN (SELECT dst FROM edges WHERE src = 'n3')")
def node_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return P.neighbours(edges(spark, d), "n3")


@query(f"WITH {EDGES_SQL} SELECT src, dst, edge_type FROM edges WHERE substr(src, 1, 1) IN ('n', 's') AND substr(dst, 1, 1) IN ('n', 's')")
def subgraph_by_type(spark: SparkSession, d: str) -> DataFrame:
    e = edges(spark, d)
    keep = G.nodes(e).where(F.substring("node", 1, 1).isin("n", "s"))
    return P.induced(e, keep).select("src", "dst", "edge_type")


@query(f"WITH {EDGES_SQL}, u AS (SELECT DISTINCT src, dst FROM edges), nodes AS (SELECT src AS node FROM u UNION SELECT dst FROM u), z AS (SELECT src, count(*) AS n FROM u GROUP BY 1), b AS (SELECT src, count(*) AS m FROM u WHERE dst IN (SELECT dst FROM u WHERE src = 'n0') GROUP BY 1), k AS (SELECT count(*) AS k FROM u WHERE src = 'n0') SELECT node, round(CASE WHEN coalesce(n, 0) + k - coalesce(m, 0) > 0 THEN coalesce(m, 0) / CAST(coalesce(n, 0) + k - coalesce(m, 0) AS DOUBLE) ELSE 0 END, 6) AS similarity FROM nodes LEFT JOIN z ON z.src = node LEFT JOIN b ON b.src = node, k WHERE node <> 'n0' ORDER BY similarity DESC, node LIMIT 10")
def similar_nodes(spark: SparkSession, d: str) -> DataFrame:
    return P.alike(edges(spark, d), "n0").select("node", F.round("similarity", 6).alias("similarity")).orderBy(F.desc("similarity"), "node").limit(10)


@query(f"""{_E}, s AS (SELECT src, dst, weight / sum(weight) OVER (PARTITION BY src) AS p FROM edges), seeds AS (SELECT node, 0.85 / count(*) OVER () AS m FROM (SELECT DISTINCT src AS node FROM edges WHERE src IN ('c1', 'c2', 'n3'))),
walk AS (SELECT node, m, 0 AS k FROM seeds UNION ALL SELECT dst, m * 0.15 * p, k + 1 FROM walk JOIN s ON src = node) SELECT node, round(sum(m), 9) AS score FROM walk GROUP BY 1 ORDER BY score DESC, node LIMIT 20""")
def seeded_ranks(spark: SparkSession, d: str) -> DataFrame:
    e = edges(spark, d)
    seeds = e.where(F.col("src").isin("c1", "c2", "n3")).select(F.col("src").alias("node")).distinct()
    return P.diffused(e, seeds, 0.85, 20).select("node", F.round("score", 9).alias("score")).orderBy(F.desc("score"), "node").limit(20)


#: Regions are the components; a nation's customers and suppliers make its paths.
_PART = "part AS (SELECT n_nationkey, 'r' || n_regionkey AS part FROM nation)"


@query(f"""WITH {_PART}, c AS (SELECT part, 'c' || c_custkey AS node, 'n' || c_nationkey AS up FROM customer JOIN part ON n_nationkey = c_nationkey WHERE c_custkey <= 400), s AS (SELECT part, 's' || s_suppkey AS node, 'n' || s_nationkey AS up FROM supplier JOIN part ON n_nationkey = s_nationkey WHERE s_suppkey <= 400),
nc AS (SELECT up, count(*) AS n FROM c GROUP BY 1), ns AS (SELECT up, count(*) AS n FROM s GROUP BY 1), size AS (SELECT part, count(*) AS n FROM (SELECT part, node FROM c UNION SELECT part, node FROM s UNION SELECT part, 'n' || n_nationkey FROM part UNION SELECT part, part FROM part) GROUP BY 1),
rows AS (SELECT part, node, 0 AS b, 0 AS reach, 0 AS dist FROM c UNION ALL SELECT p.part, 'n' || n_nationkey, coalesce(nc.n, 0) * (1 + coalesce(ns.n, 0)), coalesce(nc.n, 0), coalesce(nc.n, 0) FROM part p LEFT JOIN nc ON nc.up = 'n' || n_nationkey LEFT JOIN ns ON ns.up = 'n' || n_nationkey
  UNION ALL SELECT s.part, s.node, 0, 1 + coalesce(nc.n, 0), 1 + 2 * coalesce(nc.n, 0) FROM s LEFT JOIN nc ON nc.up = s.up UNION ALL SELECT part, part, 0, count(*) + sum(coalesce(nc.n, 0)), count(*) + 2 * sum(coalesce(nc.n, 0)) FROM part LEFT JOIN nc ON nc.up = 'n' || n_nationkey GROUP BY 1)
SELECT rows.part, node, round(CAST(b AS DOUBLE), 4) AS betweenness, round(CASE WHEN dist > 0 THEN reach * reach / CAST(dist AS DOUBLE) / (size.n - 1) ELSE 0 END, 6) AS closeness FROM rows JOIN size USING (part)""")
def path_centralities(spark: SparkSession, d: str) -> DataFrame:
    """Over a bounded graph: nations with the first customers and suppliers."""
    e = edges(spark, d)
    end = lambda c: F.substring(c, 2, 20).cast("int")
    e = e.where(F.when(F.col("edge_type") == "LIVES_IN", end("src") <= 400).when(F.col("edge_type") == "HOSTS", end("dst") <= 400).otherwise(True))
    nation = F.when(F.col("src").startswith("n"), F.col("src")).otherwise(F.col("dst"))
    of = e.where("edge_type = 'IN_REGION'").select(F.col("src").alias("nation"), F.col("dst").alias("region"))
    c = P.centralities(e.withColumn("nation", nation).join(F.broadcast(of), "nation"), F.col("region"))
    return c.select("part", "node", F.round("betweenness", 4).alias("betweenness"), F.round("closeness", 6).alias("closeness"))


@query(f"""WITH RECURSIVE {EDGES_SQL}, u AS (SELECT DISTINCT src, dst FROM edges), deg AS (SELECT node, count(*) AS n FROM (SELECT src AS node FROM u UNION ALL SELECT dst FROM u) GROUP BY 1), c AS (SELECT count(DISTINCT component) AS components FROM ({ORACLE_SQL['connected_components'].replace('WITH RECURSIVE ', 'WITH RECURSIVE ', 1)}))
SELECT (SELECT count(*) FROM deg) AS nodes, (SELECT count(*) FROM u) AS edges, round((SELECT count(*) FROM u) / CAST((SELECT count(*) FROM deg) AS DOUBLE) / ((SELECT count(*) FROM deg) - 1), 9) AS density, components, round((SELECT avg(n) FROM deg), 6) AS mean_degree, (SELECT max(n) FROM deg) AS most_degree, components = 1 AS connected FROM c""")
def graph_statistics(spark: SparkSession, d: str) -> DataFrame:
    e = edges(spark, d).select("src", "dst").distinct()
    ends = e.select(F.explode(F.array("src", "dst")).alias("node")).groupBy("node").agg(F.count("*").alias("n"))
    deg = ends.agg(F.count("*").alias("nodes"), F.avg("n").alias("mean"), F.max("n").alias("most_degree"))
    parts = G.components(edges(spark, d)).agg(F.count_distinct("component").alias("components"))
    one_row = deg.crossJoin(e.agg(F.count("*").alias("edges"))).crossJoin(parts)  # three one-row aggregates
    return one_row.select("nodes", "edges", F.round(F.try_divide(F.try_divide("edges", "nodes"), F.col("nodes") - 1), 9).alias("density"), "components", F.round("mean", 6).alias("mean_degree"), "most_degree", (F.col("components") == 1).alias("connected"))
