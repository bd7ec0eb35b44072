"""Topics, searches and factors over the tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.operators import factors as X
from docweave.operators import spectral as S
from docweave.operators import tensor_factors as T
from docweave.plans.base import query
from docweave.sources.relations import table


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as a dense table (id, v), those of the whole length."""
    e = table(spark, sf_dir, "embeddings")
    return e.where(F.col("vec_id").isNotNull() & (F.size("embedding") == 64) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x))).select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"))


def vector_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, a column for each vector: (row, col, value)."""
    return vectors(spark, sf_dir).select(F.posexplode("v").alias("row", "value"), F.col("id").alias("col")).select(F.col("row").cast("long").alias("row"), "col", "value")


@query()
def document_topics(spark: SparkSession, d: str) -> DataFrame:
    """Five topics of all documents: the terms that weigh most in the tf-idf matrix's first right vectors."""
    return X.text_topics(table(spark, d, "documents").where("text IS NOT NULL"), 5, rounds=12, tolerance=1e-8)


@query()
def svd_column_search(spark: SparkSession, d: str) -> DataFrame:
    """The ten vectors nearest to one of them by the rank-10 pseudo-inverse of all."""
    v = vectors(spark, d)
    asked = v.orderBy("id").select("v").first()
    by_vector = X.dense_svd(v, 64, 10)  # a vector in a row: the table's columns are on its left
    return X.svd_search(vector_entries(spark, d), X.Svd(by_vector.values, by_vector.right, by_vector.left), list(asked.v) if asked else [], 10)


@query()
def vector_qr(spark: SparkSession, d: str) -> DataFrame:
    """(i, j, r) of the triangular factor of all vectors, one in a row."""
    _, r = X.tall_skinny_qr(vectors(spark, d), 64)
    i, j = np.triu_indices(64)
    return spark.createDataFrame(list(zip(i.tolist(), j.tolist(), r[i, j].tolist())), "i int, j int, r double")


@query()
def vector_projections(spark: SparkSession, d: str) -> DataFrame:
    """(vec_id, component, score): all vectors on the five largest singular directions."""
    found = X.dense_svd(vectors(spark, d), 64, 5)
    each = found.left.select(F.col("id").alias("vec_id"), F.posexplode("v").alias("at", "x"))
    sizes = F.array(*(F.lit(float(s)) for s in found.values)) if len(found.values) else F.array(F.lit(0.0))
    return each.select("vec_id", (F.col("at") + 1).alias("component"), (F.col("x") * sizes[F.col("at")]).alias("score"))


def activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a tensor of user, type and hour of the day."""
    return table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("user"), F.col("event_type").alias("kind"), F.hour("ts").cast("string").alias("hour"), F.lit(1.0).alias("value"))


_MODES = ["user", "kind", "hour"]


@query()
def activity_components(spark: SparkSession, d: str) -> DataFrame:
    """(mode, id, component, loading): three rank-one parts of the events' tensor without negative entries."""
    found = T.cp(activity(spark, d), _MODES, 3, rounds=10, tolerance=1e-4)
    each = [f.select(F.lit(m).alias("mode"), "id", F.posexplode("v").alias("component", "loading")) for m, f in zip(_MODES, found.factors)]
    return each[0].unionByName(each[1]).unionByName(each[2])


@query()
def activity_core(spark: SparkSession, d: str) -> DataFrame:
    """(i, j, k, value) of the core of ranks 3, 2, 2 of the events' tensor; signs are free."""
    core = T.tucker(activity(spark, d), _MODES, [3, 2, 2], rounds=6, tolerance=1e-6).core
    return spark.createDataFrame([(*map(int, at), float(v)) for at, v in np.ndenumerate(core)], "i int, j int, k int, value double")


@query()
def market_clusters(spark: SparkSession, d: str) -> DataFrame:
    """(node, cluster): customers and parts' brands that trade with one another, in four clusters."""
    orders, lines, parts = (table(spark, d, t) for t in ("orders", "lineitem", "part"))
    sold = lines.join(orders, lines.l_orderkey == orders.o_orderkey).join(parts, lines.l_partkey == parts.p_partkey)
    edges = sold.groupBy(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("src"), F.concat(F.lit("b"), "p_brand").alias("dst")).agg(F.count("*").cast("double").alias("weight"))
    return S.spectral_clusters(edges, 4, rounds=15, tolerance=1e-5)
