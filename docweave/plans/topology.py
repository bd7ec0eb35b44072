"""Shape of the tables' points."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.operators import topology as T
from docweave.plans.base import query
from docweave.sources.relations import elements


@query()
def layout_persistence(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, dimension, birth, death): components and loops of each document's element centres, its pages laid one below the other."""
    centre = F.array((F.col("x0") + F.col("x1")) / 2, F.col("page") + (F.col("y0") + F.col("y1")) / 2)
    points = elements(spark, d).where("doc_id IS NOT NULL").select("doc_id", F.col("seq").alias("id"), centre.alias("v"))
    found = T.persistence(points, ["doc_id"], 2, 0.35)
    return found.select("doc_id", "dimension", F.round("birth", 9).alias("birth"), F.round("death", 9).alias("death"))
