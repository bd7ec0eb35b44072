"""Measures of a document's elements: information density, importance, page templates, recurrence, groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.functions import text as T
from docweave.functions import vectors as V
from docweave.operators import layout as L
from docweave.operators.graphs import written
from docweave.operators.ranks import with_below

# fixed values: weights of element types, words that tie a paragraph to a table
TYPE_WEIGHTS = {"heading": 1.5, "table": 1.8, "caption": 0.7}
TABLE_WORDS = "table|tbl|above|below"
GROUP_WEIGHT = 0.9
NEAR = 0.12
#: Words whose counts are sent to all tasks at most.
COMMON_WORDS = 100_000


def token_entropy(tokens: Column) -> Column:
    """Shannon entropy (base 2) of an array of words: one sort, one fold over runs of equal words."""
    n = F.size(tokens)
    bits = lambda c: F.when(c > 0, c * F.log2(c)).otherwise(0.0)
    start = F.struct(F.lit("").alias("last"), F.lit(0.0).alias("run"), F.lit(0.0).alias("sum"))

    def step(a: Column, x: Column) -> Column:
        same = x == a["last"]
        return F.struct(x.alias("last"), F.when(same, a["run"] + 1).otherwise(1.0).alias("run"), (a["sum"] + F.when(same, 0.0).otherwise(bits(a["run"]))).alias("sum"))

    return F.when(n > 0, F.aggregate(F.array_sort(tokens), start, step, lambda a: F.log2(n.cast("double")) - (a["sum"] + bits(a["run"])) / n)).otherwise(0.0)


def densities(elements: DataFrame) -> DataFrame:
    """With tokens, entropy, max_entropy, area, density (entropy / area), token_density, composite, quadrant of the centre."""
    e = elements.withColumn("w", T.words(F.col("content"))).withColumn("tokens", F.size("w")).withColumn("entropy", F.greatest(token_entropy(F.col("w")), F.lit(0.0)))
    e = e.withColumn("max_entropy", F.when(F.col("tokens") > 0, F.log2(F.size(F.array_distinct("w")).cast("double"))).otherwise(0.0)).withColumn("area", L.area())
    per_area = lambda c: F.when(F.col("area") > 0, c / F.col("area")).otherwise(0.0)
    right, low = (F.col("x0") + F.col("x1") >= 1).cast("int"), (F.col("y0") + F.col("y1") >= 1).cast("int")
    return e.drop("w").withColumns({
        "density": per_area(F.col("entropy")), "token_density": per_area(F.col("tokens")), "composite": F.col("tokens") * F.col("entropy") / (F.col("area") * F.col("area") + 1e-9), "quadrant": 1 + right + 2 * low,
    })


def importance(elements: DataFrame, alpha: float = 0.5, beta: float = 0.3, gamma: float = 0.2) -> DataFrame:
    """(doc_id, seq, raw, weight): rare words, type and area; text that recurs is damped; weights are scaled to 0..1.

    The counts of the commonest words go to all tasks, where the words that they cover are added up; only the others are shuffled to meet
    their counts.  What is found is written, as more than one pass over it follows.
    """
    base = elements.withColumn("w", T.words(F.col("content")))
    words = base.select("doc_id", "seq", F.explode("w").alias("word"))
    tf = written(words.groupBy("word").agg(F.count("*").alias("tf")), "words")
    common = F.broadcast(tf.orderBy(F.desc("tf"), "word").limit(COMMON_WORDS))
    known = words.join(common, "word", "left").groupBy("doc_id", "seq").agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("tf"), F.count("tf").alias("n"))
    others = words.join(common.select("word"), "word", "left_anti").join(tf, "word").groupBy("doc_id", "seq").agg(F.sum("tf").alias("tf"), F.count("*").alias("n"))
    rarity = known.unionByName(others).groupBy("doc_id", "seq").agg((F.sum("tf") / F.sum("n")).alias("mean_tf"))
    copies = elements.groupBy(T.normal_hash(F.col("content")).alias("hash")).agg(F.count("*").alias("copies"))
    e = base.drop("w").withColumn("hash", T.normal_hash(F.col("content"))).join(copies, "hash").join(rarity, ["doc_id", "seq"], "left")
    of_type = F.lit(1.0)
    for kind, weight in TYPE_WEIGHTS.items():
        of_type = F.when(F.col("type") == kind, weight).otherwise(of_type)
    rare = F.when(F.col("mean_tf").isNull(), 0.0).otherwise(1 / (1 + F.log1p("mean_tf")))
    raw = alpha * rare + beta * F.least(F.lit(1.0), of_type / 2) + gamma * F.least(F.lit(1.0), L.area() * 2)
    raw = F.when(F.col("copies") > 1, raw / F.log(2.0 + F.col("copies"))).otherwise(raw)
    scored = written(e.select("doc_id", "seq", "section", F.round(raw, 9).alias("raw")), "scored")
    ends = scored.agg(F.min("raw").alias("low"), F.max("raw").alias("high"))
    return scored.crossJoin(F.broadcast(ends)).select("doc_id", "seq", "section", "raw", F.round((F.col("raw") - F.col("low")) / (F.col("high") - F.col("low") + 1e-9), 4).alias("weight"))


def percentile(df: DataFrame, value: str) -> DataFrame:
    """With ``percentile``: the share of all rows whose value is strictly lower."""
    n = df.count()
    return with_below(df, value).withColumn("percentile", F.col("below") / F.lit(max(1, n)))


def section_cross_entropy(elements: DataFrame) -> DataFrame:
    """(section, entropy, cross, conditional): a section's entropy, plus the cross term of corpus shares over its own."""
    words = elements.select("section", F.explode(T.words(F.col("content"))).alias("word")).groupBy("section", "word").agg(F.count("*").alias("n"))
    tf = words.groupBy("word").agg(F.sum("n").alias("tf"))
    size = words.groupBy("section").agg(F.sum("n").alias("size"))
    total = tf.agg(F.sum("tf")).first()[0] or 1
    share = F.col("n") / F.col("size")
    s = words.join(tf, "word").join(F.broadcast(size), "section")
    out = s.groupBy("section").agg((-F.sum(share * F.log2(share))).alias("entropy"), (-F.sum(F.col("tf") / F.lit(total) * F.log2(share))).alias("cross"))
    return out.withColumn("conditional", F.col("entropy") + F.col("cross"))


def page_signatures(elements: DataFrame) -> DataFrame:
    """(doc_id, page, elements, tables, headings, total_area, avg_area, text_density, content_hash, signature): 16 numbers, unit length."""
    share = lambda kind: F.count_if(F.col("type") == kind) / F.count("*")
    pages = elements.groupBy("doc_id", "page").agg(
        F.count("*").alias("elements"), *(share(k).alias(k) for k in ("text", "table", "heading")), F.count_if(F.col("type") == "table").alias("tables"), F.count_if(F.col("type") == "heading").alias("headings"),
        F.round(F.sum(L.area()), 9).alias("total_area"), F.sum(F.length("content")).alias("chars"), F.array_sort(F.collect_list(F.struct("seq", "content"))).alias("lines"),
    )
    joined = F.array_join(F.transform(F.filter("lines", lambda x: x["content"] != ""), lambda x: x["content"]), " ")
    pages = pages.withColumn("avg_area", F.col("total_area") / F.col("elements")).withColumn("text_density", F.when(F.col("total_area") > 0, F.col("chars") / F.greatest(F.lit(1.0), F.col("total_area"))).otherwise(0.0))
    capped = lambda c: F.least(F.lit(1.0), c)
    zero = F.lit(0.0)
    raw = F.array(
        F.col("text"), F.col("table"), zero, F.col("heading"), zero, zero, zero, capped(F.col("tables") / 5), zero, capped(F.col("headings") / 5),
        capped(F.col("avg_area") * 2), capped(F.col("total_area")), capped(F.col("text_density") / 1000), capped(F.col("elements") / 50), zero, zero,
    )
    pages = pages.withColumn("content_hash", T.normal_hash(joined)).withColumn("raw", raw)
    return pages.withColumn("signature", F.transform("raw", lambda x: F.round(x / V.norm(F.col("raw")), 9))).drop("raw", "lines", "chars", "text", "table", "heading")


def recurrence(elements: DataFrame) -> DataFrame:
    """(hash, copies, pages): groups of equal text, white space and case apart; empty text has none."""
    e = elements.where(F.trim("content") != "").withColumn("hash", T.normal_hash(F.col("content")))
    return e.groupBy("hash").agg(F.count("*").alias("copies"), F.count_distinct("doc_id", "page").alias("pages"), F.min("type").alias("type"))


def table_groups(elements: DataFrame) -> DataFrame:
    """(doc_id, anchor, members): each table with captions, and with paragraphs that speak of a table, within ``NEAR`` vertically."""
    tables = elements.where("type = 'table'").select("doc_id", F.col("seq").alias("anchor"), F.col("y0").alias("a0"), F.col("y1").alias("a1"))
    others = elements.where((F.col("type") == "caption") | ((F.col("type") == "text") & F.lower("content").rlike(TABLE_WORDS)))
    gap = F.greatest(F.lit(0.0), F.greatest("a0", "y0") - F.least("a1", "y1"))
    pairs = tables.join(others.select("doc_id", "seq", "y0", "y1"), "doc_id").where((F.col("seq") != F.col("anchor")) & (F.round(gap, 9) <= NEAR))
    return pairs.groupBy("doc_id", "anchor").agg(F.array_sort(F.collect_list("seq")).alias("members"))


def group_scores(groups: DataFrame, seeds: DataFrame) -> DataFrame:
    """(doc_id, seq, score): 1 for a seed, else 0.6 x the weight of a group shared with one."""
    members = groups.select("doc_id", "anchor", F.explode(F.concat(F.array("anchor"), "members")).alias("seq"))
    s = seeds.select("doc_id", "seq", F.lit(True).alias("seed"))
    marked = members.join(s, ["doc_id", "seq"], "left")
    touched = marked.where("seed").select("doc_id", "anchor").distinct()
    near = marked.join(touched, ["doc_id", "anchor"], "left_semi")
    return near.groupBy("doc_id", "seq").agg(F.when(F.bool_or(F.coalesce("seed", F.lit(False))), 1.0).otherwise(0.6 * GROUP_WEIGHT).alias("score"))


def relevance(pages: list[int], section: str) -> Column:
    """0.5, and more for a page asked for or next to one, a section, a table, and a place off the margins; at most 1."""
    on = F.when(F.col("page").isin(pages), 0.3).when(F.exists(F.array(*map(F.lit, pages)), lambda p: F.abs(F.col("page") - p) == 1), 0.1).otherwise(0.0)
    cy = (F.col("y0") + F.col("y1")) / 2
    parts = [on, F.when(F.contains(F.lower("section"), F.lit(section)), 0.2).otherwise(0.0), F.when(F.col("type") == "table", 0.1).otherwise(0.0), F.when((cy > 0.1) & (cy < 0.9), 0.05).otherwise(0.0)]
    return F.least(F.lit(1.0), sum(parts, F.lit(0.5)))
