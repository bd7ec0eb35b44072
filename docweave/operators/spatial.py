"""Elements in space: pages as depth, links to what is near, fields, potentials and kernels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docweave.operators.layout import page_pairs

#: Kept off zero where a field is measured at a source.
EPSILON = 1e-6


def lifted(elements: DataFrame) -> DataFrame:
    """(doc_id, seq, page, x, y, z, width, height, depth): centres with y upwards, pages of a document one behind the other between 0 and 1.

    Elements without a box are left out.
    """
    pages = elements.groupBy("doc_id").agg(F.greatest(F.lit(1), F.max("page")).alias("pages"))
    boxed = elements.where("x0 IS NOT NULL AND y0 IS NOT NULL AND x1 IS NOT NULL AND y1 IS NOT NULL").join(pages, "doc_id")
    x, y = (F.col("x0") + F.col("x1")) / 2, 1 - (F.col("y0") + F.col("y1")) / 2
    return boxed.select("doc_id", "seq", "page", x.alias("x"), y.alias("y"), ((F.col("page") - 1) / F.col("pages")).alias("z"), (F.col("x1") - F.col("x0")).alias("width"), (F.col("y1") - F.col("y0")).alias("height"), (1 / F.col("pages")).alias("depth"))


def connections(places: DataFrame, near: int = 3) -> DataFrame:
    """(doc_id, src, dst, edge_type): the nearest others on an element's page, and the nearest on the next one; ties to the smaller seq."""
    a = places.select("doc_id", F.col("page").alias("a_page"), F.col("seq").alias("src"), *(F.col(c).alias(f"a{c}") for c in "xyz"))
    b = places.select("doc_id", F.col("page").alias("b_page"), F.col("seq").alias("dst"), *(F.col(c).alias(f"b{c}") for c in "xyz"))
    away = F.round(F.sqrt(sum(((F.col(f"a{c}") - F.col(f"b{c}")) ** 2 for c in "xyz"), F.lit(0.0))), 9)
    meet = a.withColumn("b_page", F.explode(F.array(F.col("a_page"), F.col("a_page") + 1))).join(b, ["doc_id", "b_page"]).where("src != dst")
    kind = F.when(F.col("a_page") == F.col("b_page"), "spatial_proximity").otherwise("next_page")
    ranked = meet.withColumn("edge_type", kind).withColumn("nth", F.row_number().over(Window.partitionBy("doc_id", "src", "edge_type").orderBy(away, "dst")))
    return ranked.where(F.col("nth") <= F.when(F.col("edge_type") == "next_page", 1).otherwise(near)).select("doc_id", "src", "dst", "edge_type")


def field(elements: DataFrame, weight: Column, n: int, epsilon: float = EPSILON) -> DataFrame:
    """(doc_id, page, row, col, value) on an even grid over each page, edges included: the sum of weight / (distance squared + epsilon)."""
    step = 1.0 / (n - 1)
    grid = F.explode(F.array(*(F.struct(F.lit(r).alias("row"), F.lit(c).alias("col")) for r in range(n) for c in range(n))))
    e = elements.where("x0 IS NOT NULL AND y0 IS NOT NULL").select("doc_id", "page", ((F.col("x0") + F.col("x1")) / 2).alias("x"), ((F.col("y0") + F.col("y1")) / 2).alias("y"), weight.alias("w"), grid.alias("g"))
    dx, dy = F.col("g.col") * step - F.col("x"), F.col("g.row") * step - F.col("y")
    return e.groupBy("doc_id", "page", F.col("g.row").alias("row"), F.col("g.col").alias("col")).agg(F.sum(F.col("w") / (dx * dx + dy * dy + epsilon)).alias("value"))


def potentials(elements: DataFrame, importance: Column, high: float) -> DataFrame:
    """(doc_id, seq, potential, is_high): importance, less the lower an element stands on its page; half where all stand level."""
    w = Window.partitionBy("doc_id", "page")
    low, top = F.min("y0").over(w), F.max("y0").over(w)
    score = F.when(top > low, 1 - (F.col("y0") - low) / (top - low)).otherwise(0.5)
    out = elements.select("doc_id", "seq", (importance * score).alias("potential"))
    return out.withColumn("is_high", F.col("potential") >= high)


def distance_kernel(elements: DataFrame, sigma: float, least: float) -> DataFrame:
    """(doc_id, page, a_seq, b_seq, weight): exp(-(d / sigma) squared) of the centres of a page's elements, where it is ``least`` or more."""
    p = page_pairs(elements).where("a_seq < b_seq")
    gap = lambda c: (F.col(f"a_{c}0") + F.col(f"a_{c}1") - F.col(f"b_{c}0") - F.col(f"b_{c}1")) / 2
    weight = F.exp(-(gap("x") * gap("x") + gap("y") * gap("y")) / F.lit(sigma * sigma))
    return p.select(F.col("a_doc_id").alias("doc_id"), F.col("a_page").alias("page"), "a_seq", "b_seq", weight.alias("weight")).where(F.col("weight") >= least)


def normalised(boxes: DataFrame) -> DataFrame:
    """``boxes`` (x0, y0, x1, y1, page_width, page_height) with x, y, w, h as shares of the page; zeros where a page has no size."""
    sized = (F.col("page_width") > 0) & (F.col("page_height") > 0)
    share = lambda c, of: F.coalesce(F.when(sized, c / F.nullif(F.col(of), F.lit(0))), F.lit(0.0))
    return boxes.withColumns({"x": share(F.col("x0"), "page_width"), "y": share(F.col("y0"), "page_height"), "w": share(F.col("x1") - F.col("x0"), "page_width"), "h": share(F.col("y1") - F.col("y0"), "page_height")})
