"""Neighbours in low dimensions, and walks over the graph of the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.functions import text as T
from docweave.operators import coverage as C
from docweave.operators import spectral as S
from docweave.operators.flow import hitting_times
from docweave.operators.space import nearest
from docweave.plans.base import query
from docweave.sources.relations import edges, table


@query("""WITH p AS (SELECT p_partkey AS id, CAST(p_size AS DOUBLE) AS x, CAST(p_retailprice AS DOUBLE) / 100 AS y FROM part),
d AS (SELECT q.id AS query_id, p.id, sqrt((p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y)) AS distance FROM p q, p WHERE q.id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM d)
SELECT query_id, CAST(rank AS INTEGER) AS rank, id, round(distance, 9) AS distance FROM r WHERE rank <= 5""")
def nearest_parts(spark: SparkSession, d: str) -> DataFrame:
    """The five parts nearest in size and price to every twentieth one, itself included."""
    place = F.array(F.col("p_size").cast("double"), F.col("p_retailprice").cast("double") / 100)
    points = table(spark, d, "part").select(F.col("p_partkey").alias("id"), place.alias("v"))
    found = nearest(points, points.where("id % 20 = 0").withColumnRenamed("id", "query_id"), 5, 2)
    return found.select("query_id", "rank", "id", F.round("distance", 9).alias("distance"))


@query()
def region_hitting_times(spark: SparkSession, d: str) -> DataFrame:
    """(node, steps): how many steps a walk over customers, nations and suppliers takes on average to a region; null where none is reached."""
    targets = table(spark, d, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("node"))
    return hitting_times(edges(spark, d), targets).steps


@query()
def influence(spark: SparkSession, d: str) -> DataFrame:
    """(node, centrality): eigenvector centrality of customers, nations, regions and suppliers by their links."""
    return S.eigenvector_centrality(edges(spark, d), directed=False, rounds=60)


@query()
def covering_documents(spark: SparkSession, d: str) -> DataFrame:
    """Documents of 4,000 tokens in all that cover the rarest words of the corpus."""
    docs = table(spark, d, "documents").where("text IS NOT NULL")
    items = docs.select(F.col("doc_id").alias("item"), T.tokens_by_chars(F.col("text")).alias("size"))
    covers = docs.select(F.col("doc_id").alias("item"), F.explode(F.array_distinct(T.words(F.col("text")))).alias("concept"))
    weights = covers.groupBy("concept").agg((1 / F.count("*")).alias("weight"))
    return C.best_coverage(items, covers, weights, 4000)
