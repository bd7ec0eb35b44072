"""Structures that recur at a place: headers, footers, logos, tables and duplicate blocks.

Elements of one kind and text recur together if a chain of them links them in which neighbours stand within ``tolerance`` of
each other in both axes.  Places are whole millionths of a page, so the comparison is exact.  The chains are found without pairing
elements:

- A grid cell as wide as the tolerance holds only elements that are within it of one another, so cells are linked, not elements.
- Cells side by side share one axis' range; their extremes along the other decide.
- Cells corner to corner have a pair within the tolerance if one cell's points, moved by the tolerance, dominate a point of the
  other: a running maximum over both cells' points in order.  A cell gives at most one point for each column of millionths.

Counts and extremes are taken in every task before anything is shuffled, so a text that a third of all pages share is one row for each
place that it holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docweave.operators.graphs import components, written

# fixed values: bands of a page, sizes and counts
HEADER_BAND, FOOTER_BAND, LOGO_AREA = 0.08, 0.92, 0.05
HEADER_TYPES, FOOTER_TYPES = ["header", "heading", "title", "text"], ["footer", "text", "caption"]
TEMPLATE, DOMINANT, DUPLICATE = 3, 5, 2
TOLERANCE = 0.05
UNIT = 1_000_000
#: A later kind takes an element from an earlier one.
KINDS = ["header", "footer", "logo", "table", "duplicate"]


def normal_text(content: Column) -> Column:
    """Lower case, runs of blanks one space, none at the ends; null as empty."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(content, F.lit(""))), r"\s+", " "))


def table_shape(content: Column) -> Column:
    """Most bars in one of the first three lines, and the first line; null for empty tables."""
    lines = F.slice(F.split(content, "\n"), 1, 3)
    bars = F.array_max(F.transform(lines, lambda s: F.size(F.split(s, r"\|")) - 1))
    return F.when(F.length(content) > 0, F.concat_ws("_", bars.cast("string"), F.sha2(lines[0].cast("binary"), 256)))


def near_places(items: DataFrame, keys: list[str], tolerance: int) -> DataFrame:
    """``items`` (keys, x and y in whole numbers) with ``place``: equal for items of equal keys that chains link, and only for these."""
    cell = [*keys, "cx", "cy"]
    at = lambda c: F.floor(F.col(c) / F.lit(tolerance)).cast("long")
    placed = items.withColumn("cx", at("x")).withColumn("cy", at("y"))
    # at most ``tolerance`` rows for each cell
    columns = written(placed.groupBy(*cell, "x").agg(F.min("y").alias("low"), F.max("y").alias("high")), "columns")
    cells = columns.groupBy(*cell).agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("low").alias("y0"), F.max("high").alias("y1"))

    def pairs(dx: int, dy: int, near: Column) -> DataFrame:
        """Cells a and b = a + (dx, dy) that hold ``near``."""
        a = cells.select(*keys, F.col("cx").alias("acx"), F.col("cy").alias("acy"), *(F.col(c).alias(f"a{c}") for c in ("x0", "x1", "y0", "y1")), (F.col("cx") + dx).alias("cx"), (F.col("cy") + dy).alias("cy"))
        return a.join(cells, cell).where(near).select(*keys, F.col("acx"), F.col("acy"), "cx", "cy")

    across = F.col("x0") - F.col("ax1") < tolerance
    up, down = F.col("y0") - F.col("ay1") < tolerance, F.col("ay0") - F.col("y1") < tolerance
    links = pairs(1, 0, across).unionByName(pairs(0, 1, up))
    for dy, near, sign, of_a, of_b in ((1, up, 1, "high", "low"), (-1, down, -1, "low", "high")):
        maybe = pairs(1, dy, across & near)
        # b at (x, y) has a partner if the highest a right of x - tolerance stands above y - tolerance; downwards with y mirrored
        a = maybe.join(columns.select(*keys, F.col("cx").alias("acx"), F.col("cy").alias("acy"), (F.col("x") + tolerance).alias("at"), (sign * F.col(of_a)).alias("y")), [*keys, "acx", "acy"]).withColumn("of_b", F.lit(0))
        b = maybe.join(columns.select(*cell, F.col("x").alias("at"), (sign * F.col(of_b)).alias("y")), cell).withColumn("of_b", F.lit(1))
        pair = [*keys, "acx", "acy", "cx", "cy"]
        order = Window.partitionBy(*pair).orderBy(F.desc("at"), F.desc("of_b")).rowsBetween(Window.unboundedPreceding, -1)
        highest = F.max(F.when(F.col("of_b") == 0, F.col("y"))).over(order)
        met = a.unionByName(b).withColumn("highest", highest).where(F.col("of_b") == 1).where(F.col("y") - F.col("highest") < tolerance)
        links = links.unionByName(met.select(*pair).distinct())
    node = lambda x, y: F.struct(*keys, F.col(x).alias("cx"), F.col(y).alias("cy"))
    edges = written(links.select(node("acx", "acy").alias("src"), node("cx", "cy").alias("dst")), "links")
    root = components(edges).select(F.col("node.*"), F.struct("component.cx", "component.cy").alias("root"))
    return placed.join(root, cell, "left").withColumn("place", F.coalesce("root", F.struct("cx", "cy"))).drop("cx", "cy", "root")


def candidates(elements: DataFrame) -> DataFrame:
    """A row for each element and kind that it may recur as, with ``kind`` and ``key``; duplicates are what is left."""
    y0, y1 = F.least("y0", "y1"), F.greatest("y0", "y1")
    kind = F.col("type")
    is_kind = {
        "header": (y0 < HEADER_BAND) & kind.isin(HEADER_TYPES),
        "footer": (y1 > FOOTER_BAND) & kind.isin(FOOTER_TYPES),
        "logo": (kind == "figure") & ((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")) < LOGO_AREA),
        "table": (kind == "table") & table_shape(F.col("content")).isNotNull(),
    }
    found = F.filter(F.array(*(F.when(test, F.lit(name)) for name, test in is_kind.items())), lambda x: x.isNotNull())
    kinds = F.when(F.size(found) > 0, found).when(normal_text(F.col("content")) != "", F.array(F.lit("duplicate"))).otherwise(F.array().cast("array<string>"))
    each = elements.withColumn("kind", F.explode(kinds))
    return each.withColumn("key", F.when(F.col("kind") == "table", table_shape(F.col("content"))).otherwise(F.sha2(normal_text(F.col("content")).cast("binary"), 256)))


def recurrence(elements: DataFrame, scope: list[str], order: list[str], tolerance: float = TOLERANCE) -> DataFrame:
    """(scope, order, page, kind, key, place, first, members, pages, is_template, is_dominant): an element's groups.

    elements: (scope, order, page, type, content, x0, y0, x1, y1), null boxes allowed.  Elements are grouped within ``scope``
    (columns; none groups the whole corpus); ``order`` (columns) tells elements apart within it, and the least of a group is its
    ``first``.  Headers, footers and logos recur at a place, tables by their shape, duplicates by their text.  An element may
    be of several of these kinds and has a row for each; one that is of none has no row, nor has a text that stands once.
    Elements with null boxes, or no place, are never headers, footers or logos.
    """
    every = candidates(elements.select(*scope, *order, "page", "type", "content", "x0", "y0", "x1", "y1"))
    fixed = lambda c: F.round(F.col(c) * UNIT).cast("long")
    rows = written(every.select(*scope, *order, "page", "kind", "key", fixed("x0").alias("x"), fixed("y0").alias("y")), "candidates")
    keys = [*scope, "kind", "key"]
    by_place = F.col("kind").isin("header", "footer", "logo")
    placed = near_places(rows.where(by_place & F.col("x").isNotNull() & F.col("y").isNotNull()), keys, round(tolerance * UNIT))
    anywhere = rows.where(~by_place).withColumn("place", F.lit(None).cast(placed.schema["place"].dataType))
    members = placed.unionByName(anywhere).drop("x", "y")
    group = [*keys, F.coalesce("place", F.struct(F.lit(-1).cast("long").alias("cx"), F.lit(-1).cast("long").alias("cy"))).alias("place")]
    members = members.select(*scope, *order, "page", *group[len(scope) :])
    sizes = members.groupBy(*keys, "place").agg(F.min(F.struct(*order)).alias("first"), F.count("*").alias("members"), F.count_distinct("page").alias("pages"))
    kept = sizes.where((F.col("kind") != "duplicate") | (F.col("members") >= DUPLICATE))
    out = members.join(kept, [*keys, "place"])
    return out.withColumn("is_template", F.col("members") >= TEMPLATE).withColumn("is_dominant", F.col("members") >= DOMINANT)


def numbered(groups: DataFrame, scope: list[str]) -> DataFrame:
    """``groups`` with ``recurrence_id``: kind and number by first member within the scope, as "header-1"."""
    nth = F.row_number().over(Window.partitionBy(*scope, "kind").orderBy("first", "key"))
    return groups.withColumn("recurrence_id", F.concat_ws("-", "kind", nth.cast("string")))


def marked(elements: DataFrame, members: DataFrame, scope: list[str], order: list[str]) -> DataFrame:
    """All elements with ``kind``, ``frequency`` and ``is_template``: those of the last of its kinds; 1 and no kind for others.

    Headers and footers by type, and elements whose centre stands in the bands, are templates at any frequency.
    """
    rank = F.array_position(F.array(*(F.lit(k) for k in KINDS)), F.col("kind"))
    own = members.groupBy(*scope, *order).agg(F.max_by(F.struct("kind", "members", "is_template"), rank).alias("own"))
    centre = (F.col("y0") + F.col("y1")) / 2
    banded = F.coalesce(F.col("type").isin("header", "footer") | (centre < HEADER_BAND) | (centre > FOOTER_BAND), F.lit(False))
    joined = elements.join(own, [*scope, *order], "left")
    return joined.select(*(elements[c] for c in elements.columns), F.col("own.kind").alias("kind"), F.coalesce("own.members", F.lit(1)).alias("frequency"), (F.coalesce("own.is_template", F.lit(False)) | banded).alias("is_template"))


def savings(groups: DataFrame, scope: list[str], size: int = 200) -> DataFrame:
    """(scope, groups, templates, elements, avg_compression, saved_bytes): each group stored once, an element being of ``size`` bytes."""
    g = groups.groupBy(*scope).agg(F.count("*").alias("groups"), F.count_if(F.col("members") >= TEMPLATE).alias("templates"), F.sum("members").alias("elements"))
    return g.select(*scope, "groups", "templates", "elements", (F.col("groups") / F.col("elements")).alias("avg_compression"), ((F.col("elements") - F.col("groups")) * size).alias("saved_bytes"))
