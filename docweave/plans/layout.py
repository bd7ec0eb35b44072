"""Layout of the documents' lines as elements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docweave.operators import layout as L
from docweave.plans.base import query
from docweave.sources.relations import ELEMENTS_SQL, elements

_E = f"WITH {ELEMENTS_SQL}"
_PAIRS = "pairs AS (SELECT a.doc_id, a.page, a.seq AS a_seq, b.seq AS b_seq, a.type AS a_type, b.type AS b_type, a.x0 AS ax0, a.y0 AS ay0, a.x1 AS ax1, a.y1 AS ay1, b.x0 AS bx0, b.y0 AS by0, b.x1 AS bx1, b.y1 AS by1 FROM elements a JOIN elements b ON a.doc_id = b.doc_id AND a.page = b.page AND a.seq <> b.seq)"
_OX = "greatest(0, least(ax1, bx1) - greatest(ax0, bx0))"
_OY = "greatest(0, least(ay1, by1) - greatest(ay0, by0))"
_AREA = "(ax1 - ax0) * (ay1 - ay0) + (bx1 - bx0) * (by1 - by0)"
_GAPX, _GAPY = ("greatest(0, greatest(a{0}0, b{0}0) - least(a{0}1, b{0}1))".format(a) for a in "xy")
_CD = "sqrt(pow((ax0 + ax1) / 2 - (bx0 + bx1) / 2, 2) + pow((ay0 + ay1) / 2 - (by0 + by1) / 2, 2))"


@query(f"{_E} SELECT doc_id, seq, page, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY page, y0, x0, seq) AS INTEGER) AS position FROM elements")
def reading_order(spark: SparkSession, d: str) -> DataFrame:
    return L.reading_order(elements(spark, d)).select("doc_id", "seq", "page", "position")


@query(f"{_E} SELECT doc_id, seq, type, round((x1 - x0) * (y1 - y0), 6) AS area, round((x0 + x1) / 2, 6) AS cx, round((y0 + y1) / 2, 6) AS cy FROM elements WHERE x0 < 0.5 AND x1 > 0.1 AND y0 < 0.5 AND y1 > 0.1")
def elements_in_region(spark: SparkSession, d: str) -> DataFrame:
    e = elements(spark, d).where("x0 < 0.5 AND x1 > 0.1 AND y0 < 0.5 AND y1 > 0.1")
    return e.select("doc_id", "seq", "type", F.round(L.area(), 6).alias("area"), F.round((F.col("x0") + F.col("x1")) / 2, 6).alias("cx"), F.round((F.col("y0") + F.col("y1")) / 2, 6).alias("cy"))


@query(f"{_E}, {_PAIRS} SELECT doc_id, page, a_seq, b_seq, round(CASE WHEN {_AREA} - {_OX} * {_OY} > 0 THEN {_OX} * {_OY} / ({_AREA} - {_OX} * {_OY}) ELSE 0 END, 6) AS iou, round(sqrt(pow({_GAPX}, 2) + pow({_GAPY}, 2)), 6) AS boundary, round({_GAPY}, 6) AS vertical_gap, round({_CD}, 6) AS distance FROM pairs WHERE a_seq < b_seq")
def box_relations(spark: SparkSession, d: str) -> DataFrame:
    p = L.page_pairs(elements(spark, d)).where("a_seq < b_seq")
    return p.select(F.col("a_doc_id").alias("doc_id"), F.col("a_page").alias("page"), "a_seq", "b_seq", F.round(L.iou("a_", "b_"), 6).alias("iou"), F.round(L.boundary_distance("a_", "b_"), 6).alias("boundary"), F.round(L.vertical_gap("a_", "b_"), 6).alias("vertical_gap"), F.round(L.centre_distance("a_", "b_"), 6).alias("distance"))


@query(f"{_E}, {_PAIRS}, r AS (SELECT doc_id, a_seq, b_seq, {_CD} AS dist, row_number() OVER (PARTITION BY doc_id, a_seq ORDER BY round({_CD}, 9), b_seq) AS rank FROM pairs) SELECT doc_id, a_seq, b_seq, round(dist, 6) AS distance, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 2")
def nearest_elements(spark: SparkSession, d: str) -> DataFrame:
    p = L.page_pairs(elements(spark, d)).withColumn("dist", L.centre_distance("a_", "b_"))
    r = p.withColumn("rank", F.row_number().over(Window.partitionBy("a_doc_id", "a_seq").orderBy(F.round("dist", 9), "b_seq"))).where("rank <= 2")
    return r.select(F.col("a_doc_id").alias("doc_id"), "a_seq", "b_seq", F.round("dist", 6).alias("distance"), "rank")


@query(f"{_E}, {_PAIRS}, r AS (SELECT doc_id, a_seq, b_seq, row_number() OVER (PARTITION BY doc_id, a_seq ORDER BY round(ay0 - by1, 9), b_seq) AS rank FROM pairs WHERE by1 <= ay0) SELECT doc_id, a_seq, b_seq FROM r WHERE rank = 1")
def element_above(spark: SparkSession, d: str) -> DataFrame:
    p = L.page_pairs(elements(spark, d)).where("b_y1 <= a_y0")
    best = p.groupBy("a_doc_id", "a_seq").agg(F.min_by("b_seq", F.struct(F.round(F.col("a_y0") - F.col("b_y1"), 9), "b_seq")).alias("b_seq"))
    return best.select(F.col("a_doc_id").alias("doc_id"), "a_seq", "b_seq")


@query(f"{_E}, {_PAIRS}, r AS (SELECT doc_id, a_seq, b_seq, row_number() OVER (PARTITION BY doc_id, a_seq ORDER BY b_seq) AS rank FROM pairs WHERE a_type = 'table' AND b_type = 'caption' AND abs((ax0 + ax1) / 2 - (bx0 + bx1) / 2) < 0.3) SELECT doc_id, a_seq AS table_seq, b_seq AS caption_seq FROM r WHERE rank = 1")
def table_captions(spark: SparkSession, d: str) -> DataFrame:
    near = F.abs((F.col("a_x0") + F.col("a_x1")) / 2 - (F.col("b_x0") + F.col("b_x1")) / 2) < 0.3
    p = L.page_pairs(elements(spark, d)).where((F.col("a_type") == "table") & (F.col("b_type") == "caption") & near)
    return p.groupBy(F.col("a_doc_id").alias("doc_id"), F.col("a_seq").alias("table_seq")).agg(F.min("b_seq").alias("caption_seq"))


@query(f"{_E}, g AS (SELECT doc_id, page, CASE WHEN x0 - lag(x0) OVER (PARTITION BY doc_id, page ORDER BY x0, seq) > 0.15 THEN 1 ELSE 0 END AS g FROM elements) SELECT doc_id, page, CAST(CASE WHEN count(*) < 4 THEN 1 ELSE 1 + sum(g) END AS BIGINT) AS columns FROM g GROUP BY 1, 2")
def column_counts(spark: SparkSession, d: str) -> DataFrame:
    return L.column_counts(elements(spark, d), 0.15)


@query(f"{_E} SELECT doc_id, seq, coalesce(last_value(CASE WHEN type = 'heading' THEN content END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY seq), '(preamble)') AS heading FROM elements")
def section_headings(spark: SparkSession, d: str) -> DataFrame:
    return L.sections(elements(spark, d)).select("doc_id", "seq", "heading")


@query(f"{_E}, c AS (SELECT doc_id, page, unnest(range(least(7, CAST(floor(y0 * 8) AS INTEGER)), least(7, CAST(floor(y1 * 8) AS INTEGER)) + 1)) AS row, least(7, CAST(floor(x0 * 8) AS INTEGER)) AS a, least(7, CAST(floor(x1 * 8) AS INTEGER)) AS b FROM elements), f AS (SELECT doc_id, page, row, unnest(range(a, b + 1)) AS col FROM c) SELECT doc_id, page, CAST(row AS INTEGER) AS row, CAST(col AS INTEGER) AS col, count(*) AS weight FROM f GROUP BY 1, 2, 3, 4")
def density_field(spark: SparkSession, d: str) -> DataFrame:
    return L.density_field(elements(spark, d), 8)


@query(f"{_E} SELECT doc_id, page, count(*) AS elements, count(DISTINCT type) AS types, count(*) FILTER (type = 'table') AS tables, round(sum((x1 - x0) * (y1 - y0)), 6) AS covered FROM elements GROUP BY 1, 2")
def page_profiles(spark: SparkSession, d: str) -> DataFrame:
    return elements(spark, d).groupBy("doc_id", "page").agg(F.count("*").alias("elements"), F.count_distinct("type").alias("types"), F.count_if(F.col("type") == "table").alias("tables"), F.round(F.sum(L.area()), 6).alias("covered"))


@query(f"{_E}, s AS (SELECT doc_id, page, string_agg(type || ':' || round(x0, 1) || ',' || round(y0, 1), ';' ORDER BY seq) AS shape FROM elements GROUP BY 1, 2), h AS (SELECT sha256(shape) AS template, count(*) AS pages, min(doc_id) AS first FROM s GROUP BY 1) SELECT * FROM h WHERE pages >= 3")
def page_templates(spark: SparkSession, d: str) -> DataFrame:
    """Pages of one shape: types and rounded places in order, three pages or more."""
    part = F.concat_ws("", "type", F.lit(":"), F.round("x0", 1).cast("string"), F.lit(","), F.round("y0", 1).cast("string"))
    s = elements(spark, d).groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(F.struct("seq", part.alias("p")))).alias("ps"))
    shape = F.sha2(F.array_join(F.transform("ps", lambda x: x["p"]), ";").cast("binary"), 256)
    return s.groupBy(shape.alias("template")).agg(F.count("*").alias("pages"), F.min("doc_id").alias("first")).where("pages >= 3")


@query(f"{_E}, f AS (SELECT doc_id, seq AS src, lead(seq) OVER (PARTITION BY doc_id, page ORDER BY y0, x0, seq) AS dst, 'FOLLOWS' AS edge_type, CAST(1.0 AS DOUBLE) AS weight FROM elements) SELECT * FROM f WHERE dst IS NOT NULL UNION ALL SELECT doc_id, src, dst, 'NEXT_PAGE', CAST(0.8 AS DOUBLE) FROM (SELECT doc_id, page, max(seq) AS src, lead(min(seq)) OVER (PARTITION BY doc_id ORDER BY page) AS dst FROM elements GROUP BY 1, 2) WHERE dst IS NOT NULL")
def reading_edges(spark: SparkSession, d: str) -> DataFrame:
    e = elements(spark, d)
    follows = e.select("doc_id", F.col("seq").alias("src"), F.lead("seq").over(Window.partitionBy("doc_id", "page").orderBy("y0", "x0", "seq")).alias("dst"), F.lit("FOLLOWS").alias("edge_type"), F.lit(1.0).alias("weight"))
    pages = e.groupBy("doc_id", "page").agg(F.max("seq").alias("src"), F.min("seq").alias("first"))
    turn = pages.select("doc_id", "src", F.lead("first").over(Window.partitionBy("doc_id").orderBy("page")).alias("dst"), F.lit("NEXT_PAGE").alias("edge_type"), F.lit(0.8).alias("weight"))
    return follows.unionByName(turn).where("dst IS NOT NULL")
