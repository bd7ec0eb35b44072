"""Documents' elements in space, and small reports on elements and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.operators import spatial as S
from docweave.plans.base import query
from docweave.sources.relations import ELEMENTS_SQL, elements, table

_LIFTED = f"""
WITH {ELEMENTS_SQL},
lifted AS (SELECT doc_id, seq, page, (x0 + x1) / 2 AS x, 1 - (y0 + y1) / 2 AS y, CAST(page - 1 AS DOUBLE) / max(page) OVER (PARTITION BY doc_id) AS z, x1 - x0 AS width, y1 - y0 AS height, CAST(1 AS DOUBLE) / max(page) OVER (PARTITION BY doc_id) AS depth FROM elements)"""


@query(f"{_LIFTED} SELECT doc_id, seq, page, round(x, 9) AS x, round(y, 9) AS y, round(z, 9) AS z, round(width, 9) AS width, round(height, 9) AS height, round(depth, 9) AS depth FROM lifted")
def lifted_elements(spark: SparkSession, d: str) -> DataFrame:
    out = S.lifted(elements(spark, d))
    return out.select("doc_id", "seq", "page", *(F.round(c, 9).alias(c) for c in ("x", "y", "z", "width", "height", "depth")))


@query(f"""{_LIFTED},
pair AS (SELECT a.doc_id, a.seq AS src, b.seq AS dst, CASE WHEN a.page = b.page THEN 'spatial_proximity' ELSE 'next_page' END AS edge_type,
  round(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)), 9) AS away
  FROM lifted a JOIN lifted b ON a.doc_id = b.doc_id AND (b.page = a.page OR b.page = a.page + 1) AND a.seq <> b.seq),
nth AS (SELECT *, row_number() OVER (PARTITION BY doc_id, src, edge_type ORDER BY away, dst) AS nth FROM pair)
SELECT doc_id, src, dst, edge_type FROM nth WHERE nth <= CASE WHEN edge_type = 'next_page' THEN 1 ELSE 3 END""")
def element_connections(spark: SparkSession, d: str) -> DataFrame:
    return S.connections(S.lifted(elements(spark, d)))


@query(f"""WITH {ELEMENTS_SQL},
g AS (SELECT doc_id, page, (x0 + x1) / 2 AS x, (y0 + y1) / 2 AS y, length(content) AS w, r.i AS "row", c.i AS col FROM elements, range(0, 5) r(i), range(0, 5) c(i))
SELECT doc_id, page, CAST("row" AS INTEGER) AS "row", CAST(col AS INTEGER) AS col, round(sum(w / ((col * 0.25 - x) * (col * 0.25 - x) + ("row" * 0.25 - y) * ("row" * 0.25 - y) + 0.001)), 4) AS value FROM g GROUP BY ALL""")
def page_fields(spark: SparkSession, d: str) -> DataFrame:
    """Each element draws by the length of its text."""
    return S.field(elements(spark, d), F.length("content"), 5, 0.001).withColumn("value", F.round("value", 4))


@query(f"""WITH {ELEMENTS_SQL}, p AS (SELECT doc_id, seq, length(content) / 100.0 * CASE WHEN max(y0) OVER w > min(y0) OVER w THEN 1 - (y0 - min(y0) OVER w) / (max(y0) OVER w - min(y0) OVER w) ELSE 0.5 END AS potential FROM elements WINDOW w AS (PARTITION BY doc_id, page))
SELECT doc_id, seq, round(potential, 6) AS potential, round(potential, 6) >= 0.5 AS is_high FROM p""")
def element_potentials(spark: SparkSession, d: str) -> DataFrame:
    out = S.potentials(elements(spark, d), F.length("content") / 100, 0.5)
    return out.withColumn("potential", F.round("potential", 6)).withColumn("is_high", F.col("potential") >= 0.5)


@query(f"""WITH {ELEMENTS_SQL},
k AS (SELECT a.doc_id, a.page, a.seq AS a_seq, b.seq AS b_seq, exp(-(pow((a.x0 + a.x1 - b.x0 - b.x1) / 2, 2) + pow((a.y0 + a.y1 - b.y0 - b.y1) / 2, 2)) / 0.25) AS weight FROM elements a JOIN elements b ON a.doc_id = b.doc_id AND a.page = b.page AND a.seq < b.seq)
SELECT doc_id, page, a_seq, b_seq, round(weight, 6) AS weight FROM k WHERE weight >= 0.2""")
def distance_kernel(spark: SparkSession, d: str) -> DataFrame:
    return S.distance_kernel(elements(spark, d), 0.5, 0.2).withColumn("weight", F.round("weight", 6))


@query(f"""WITH {ELEMENTS_SQL}, s AS (SELECT doc_id, seq, x0 * 612 AS x0, y0 * 792 AS y0, x1 * 612 AS x1, y1 * 792 AS y1, CASE WHEN doc_id % 10 = 0 THEN 0 ELSE 612 END AS w FROM elements)
SELECT doc_id, seq, round(CASE WHEN w > 0 THEN x0 / w ELSE 0 END, 9) AS x, round(CASE WHEN w > 0 THEN y0 / 792 ELSE 0 END, 9) AS y, round(CASE WHEN w > 0 THEN (x1 - x0) / w ELSE 0 END, 9) AS w, round(CASE WHEN w > 0 THEN (y1 - y0) / 792 ELSE 0 END, 9) AS h FROM s""")
def normalised_boxes(spark: SparkSession, d: str) -> DataFrame:
    """Boxes in points, every tenth document's pages having no width."""
    width = F.when(F.col("doc_id") % 10 == 0, 0).otherwise(612)
    boxes = elements(spark, d).select("doc_id", "seq", *((F.col(c) * s).alias(c) for c, s in (("x0", 612), ("y0", 792), ("x1", 612), ("y1", 792))), width.alias("page_width"), F.lit(792).alias("page_height"))
    return S.normalised(boxes).select("doc_id", "seq", *(F.round(c, 9).alias(c) for c in ("x", "y", "w", "h")))


@query("SELECT user_id, event_type, CAST(extract('hour' FROM ts) AS INTEGER) AS hour, count(*) AS n FROM events GROUP BY GROUPING SETS ((user_id, event_type), (user_id, hour), (user_id))")
def annotation_counts(spark: SparkSession, d: str) -> DataFrame:
    """A user's notes by type, by hour, and in all, from one scan."""
    e = table(spark, d, "events").select("user_id", "event_type", F.hour("ts").alias("hour"))
    return e.groupingSets([["user_id", "event_type"], ["user_id", "hour"], ["user_id"]], "user_id", "event_type", "hour").agg(F.count("*").alias("n"))


@query(f"WITH {ELEMENTS_SQL} SELECT doc_id, seq, 'ORGANIZATION' AS entity_type FROM elements WHERE regexp_matches(lower(content), 'corp|inc|acme|pharmacare|globaltech')")
def organisation_mentions(spark: SparkSession, d: str) -> DataFrame:
    """Elements that hold a listed part of a name, in any word."""
    # fixed values
    parts = ["corp", "inc", "acme", "pharmacare", "globaltech"]
    return elements(spark, d).where(F.lower("content").rlike("|".join(parts))).select("doc_id", "seq", F.lit("ORGANIZATION").alias("entity_type"))
