"""Page layout over elements with boxes: order, distance, overlap, columns, sections, density."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def area(p: str = "") -> Column:
    return (F.col(f"{p}x1") - F.col(f"{p}x0")) * (F.col(f"{p}y1") - F.col(f"{p}y0"))


def overlap(a: str, b: str, axis: str) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.col(f"{a}{axis}1"), F.col(f"{b}{axis}1")) - F.greatest(F.col(f"{a}{axis}0"), F.col(f"{b}{axis}0")))


def iou(a: str, b: str) -> Column:
    both = overlap(a, b, "x") * overlap(a, b, "y")
    union = area(a) + area(b) - both
    return F.when(union > 0, both / union).otherwise(0.0)


def vertical_gap(a: str, b: str) -> Column:
    return F.greatest(F.lit(0.0), F.greatest(F.col(f"{a}y0"), F.col(f"{b}y0")) - F.least(F.col(f"{a}y1"), F.col(f"{b}y1")))


def boundary_distance(a: str, b: str) -> Column:
    gap = lambda axis: F.greatest(F.lit(0.0), F.greatest(F.col(f"{a}{axis}0"), F.col(f"{b}{axis}0")) - F.least(F.col(f"{a}{axis}1"), F.col(f"{b}{axis}1")))
    return F.sqrt(F.pow(gap("x"), 2) + F.pow(gap("y"), 2))


def centre_distance(a: str, b: str, page_weight: float = 1.5) -> Column:
    c = lambda p, axis: (F.col(f"{p}{axis}0") + F.col(f"{p}{axis}1")) / 2
    return F.sqrt(F.pow(c(a, "x") - c(b, "x"), 2) + F.pow(c(a, "y") - c(b, "y"), 2)) + page_weight * F.abs(F.col(f"{a}page") - F.col(f"{b}page"))


def named(elements: DataFrame, prefix: str, columns: list[str]) -> DataFrame:
    return elements.select(*(F.col(c).alias(prefix + c) for c in columns))


def page_pairs(elements: DataFrame) -> DataFrame:
    """Pairs a_, b_ of elements of one page, in order: a page's elements are shuffled once and paired with one another there."""
    place, cols = ["doc_id", "page"], ["seq", "type", "x0", "y0", "x1", "y1"]
    pages = elements.where("doc_id IS NOT NULL AND page IS NOT NULL").groupBy(*place).agg(F.collect_list(F.struct(*cols)).alias("e"))
    a = pages.select(*place, F.explode("e").alias("a"), "e")
    pairs = a.select(*place, "a", F.explode("e").alias("b")).where("a.seq != b.seq")
    both = lambda p: [F.col(c).alias(f"{p}_{c}") if c in place else F.col(f"{p}.{c}").alias(f"{p}_{c}") for c in ["doc_id", "seq", "page", *cols[1:]]]
    return pairs.select(*both("a"), *both("b"))


def reading_order(elements: DataFrame) -> DataFrame:
    """With ``position`` in its document from 1: by page, top, left, then input order."""
    w = Window.partitionBy("doc_id").orderBy("page", F.coalesce("y0", F.lit(0.0)), F.coalesce("x0", F.lit(0.0)), "seq")
    return elements.withColumn("position", F.row_number().over(w))


def column_counts(elements: DataFrame, gap: float) -> DataFrame:
    """(doc_id, page, columns): 1 + gaps over ``gap`` between sorted left edges; 1 for fewer than four elements."""
    w = Window.partitionBy("doc_id", "page").orderBy("x0", "seq")
    g = elements.withColumn("g", (F.col("x0") - F.lag("x0").over(w) > gap).cast("int"))
    return g.groupBy("doc_id", "page").agg(F.when(F.count("*") < 4, 1).otherwise(1 + F.coalesce(F.sum("g"), F.lit(0))).cast("long").alias("columns"))


def sections(elements: DataFrame) -> DataFrame:
    """With the last heading at or before each element."""
    heading = F.when(F.col("type") == "heading", F.col("content"))
    return elements.withColumn("heading", F.coalesce(F.last(heading, ignorenulls=True).over(Window.partitionBy("doc_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)), F.lit("(preamble)")))


def density_field(elements: DataFrame, n: int) -> DataFrame:
    """(doc_id, page, row, col, weight) of an n x n grid: elements that touch a cell."""
    cell = lambda c: F.least(F.lit(n - 1), F.greatest(F.lit(0), F.floor(F.col(c) * n))).cast("int")
    e = elements.select("doc_id", "page", F.explode(F.sequence(cell("y0"), cell("y1"))).alias("row"), cell("x0").alias("a"), cell("x1").alias("b"))
    return e.select("doc_id", "page", "row", F.explode(F.sequence("a", "b")).alias("col")).groupBy("doc_id", "page", "row", "col").agg(F.count("*").alias("weight"))
