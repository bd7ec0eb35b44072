"""Densities, importance, templates and recurrence of the documents' lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.functions import vectors as V
from docweave.operators import elements as E
from docweave.operators import graphs as G
from docweave.operators import layout as L
from docweave.plans.base import query
from docweave.sources.relations import ELEMENTS_SQL, elements

_E = f"WITH {ELEMENTS_SQL}"
_WORDS = r"regexp_extract_all(lower(content), '[\p{L}\p{N}_]+')"
_NORM = r"trim(regexp_replace(coalesce(content, ''), '\s+', ' ', 'g'))"
_HASH = f"substr(sha256(lower({_NORM})), 1, 16)"
_AREA = "(x1 - x0) * (y1 - y0)"
_DENSE = f"""{_E}, t AS (SELECT *, {_WORDS} AS w, {_AREA} AS area FROM elements), dense AS (SELECT *, len(w) AS tokens, greatest(coalesce(list_entropy(w), 0), 0) AS entropy,
  CASE WHEN len(w) > 0 THEN log2(list_unique(w)) ELSE 0 END AS max_entropy, 1 + CASE WHEN x0 + x1 >= 1 THEN 1 ELSE 0 END + CASE WHEN y0 + y1 >= 1 THEN 2 ELSE 0 END AS quadrant FROM t)"""


@query(f"""{_DENSE} SELECT doc_id, seq, CAST(tokens AS INTEGER) AS tokens, round(entropy, 4) AS entropy, round(CASE WHEN max_entropy > 0 THEN entropy / max_entropy ELSE 0 END, 4) AS normalized, round(entropy / area, 3) AS density,
  round(tokens / area, 3) AS token_density, round(tokens * entropy / (area * area + 1e-9), 1) AS composite, CAST(quadrant AS INTEGER) AS quadrant FROM dense""")
def element_densities(spark: SparkSession, d: str) -> DataFrame:
    e = E.densities(elements(spark, d))
    normalized = F.when(F.col("max_entropy") > 0, F.col("entropy") / F.col("max_entropy")).otherwise(0.0)
    return e.select("doc_id", "seq", "tokens", F.round("entropy", 4).alias("entropy"), F.round(normalized, 4).alias("normalized"), F.round("density", 3).alias("density"), F.round("token_density", 3).alias("token_density"), F.round("composite", 1).alias("composite"), "quadrant")


@query(f"{_DENSE}, r AS (SELECT doc_id, seq, round(entropy / area, 6) AS density FROM dense) SELECT doc_id, seq, density FROM r ORDER BY density DESC, doc_id, seq LIMIT 20")
def densest_elements(spark: SparkSession, d: str) -> DataFrame:
    return E.densities(elements(spark, d)).select("doc_id", "seq", F.round("density", 6).alias("density")).orderBy(F.desc("density"), "doc_id", "seq").limit(20)


@query(f"{_DENSE}, r AS (SELECT doc_id, seq, round(entropy / area, 6) AS density FROM dense) SELECT doc_id, seq, density, round((rank() OVER (ORDER BY density) - 1) / CAST(count(*) OVER () AS DOUBLE), 6) AS percentile FROM r")
def density_percentiles(spark: SparkSession, d: str) -> DataFrame:
    e = E.percentile(E.densities(elements(spark, d)).select("doc_id", "seq", F.round("density", 6).alias("density")), "density")
    return e.select("doc_id", "seq", "density", F.round("percentile", 6).alias("percentile"))


@query(f"{_DENSE}, r AS (SELECT doc_id, seq, round(entropy / area, 6) AS density FROM dense) SELECT doc_id, seq, density, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY density DESC, seq) - 1 AS INTEGER) AS priority FROM r")
def entropy_priorities(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    e = E.densities(elements(spark, d)).select("doc_id", "seq", F.round("density", 6).alias("density"))
    return e.withColumn("priority", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("density"), "seq")) - 1)


@query(f"{_DENSE} SELECT doc_id, page, CAST(sum(tokens) AS BIGINT) AS tokens, count(*) AS n, round(sum(area), 6) AS area, round(sum(tokens) / sum(area), 3) AS token_density, round(avg(entropy), 4) AS mean_entropy, round(max(entropy / area), 3) AS densest FROM dense GROUP BY 1, 2")
def page_densities(spark: SparkSession, d: str) -> DataFrame:
    e = E.densities(elements(spark, d)).groupBy("doc_id", "page").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("n"), F.sum("area").alias("a"), F.avg("entropy").alias("h"), F.max("density").alias("m"))
    return e.select("doc_id", "page", "tokens", "n", F.round("a", 6).alias("area"), F.round(F.col("tokens") / F.col("a"), 3).alias("token_density"), F.round("h", 4).alias("mean_entropy"), F.round("m", 3).alias("densest"))


_IMPORTANCE = f"""{_E}, ew AS (SELECT doc_id, seq, unnest({_WORDS}) AS word FROM elements), tf AS (SELECT word, count(*) AS tf FROM ew GROUP BY 1), rarity AS (SELECT doc_id, seq, avg(tf) AS mean_tf FROM ew JOIN tf USING (word) GROUP BY 1, 2),
copies AS (SELECT {_HASH} AS hash, count(*) AS copies FROM elements GROUP BY 1),
raw0 AS (SELECT e.doc_id, e.seq, e.section, copies, 0.5 * CASE WHEN mean_tf IS NULL THEN 0 ELSE 1 / (1 + ln(1 + mean_tf)) END + 0.3 * least(1, CASE type WHEN 'heading' THEN CAST(1.5 AS DOUBLE) WHEN 'table' THEN 1.8 WHEN 'caption' THEN 0.7 ELSE 1 END / 2) + 0.2 * least(1, {_AREA} * 2) AS r
  FROM elements e JOIN copies c ON c.hash = {_HASH.replace('content', 'e.content')} LEFT JOIN rarity USING (doc_id, seq)),
scored AS (SELECT doc_id, seq, section, round(CASE WHEN copies > 1 THEN r / ln(2 + copies) ELSE r END, 9) AS raw FROM raw0),
weighed AS (SELECT *, round((raw - min(raw) OVER ()) / (max(raw) OVER () - min(raw) OVER () + 1e-9), 4) AS weight FROM scored)"""


@query(f"{_IMPORTANCE} SELECT doc_id, seq, round(raw, 6) AS raw, weight, round((rank() OVER (ORDER BY weight) - 1) / CAST(count(*) OVER () AS DOUBLE), 6) AS percentile FROM weighed")
def importance_weights(spark: SparkSession, d: str) -> DataFrame:
    e = E.percentile(E.importance(elements(spark, d)), "weight")
    return e.select("doc_id", "seq", F.round("raw", 6).alias("raw"), "weight", F.round("percentile", 6).alias("percentile"))


@query(f"{_IMPORTANCE} SELECT doc_id, seq, weight FROM weighed ORDER BY weight DESC, doc_id, seq LIMIT 25")
def most_important_elements(spark: SparkSession, d: str) -> DataFrame:
    return E.importance(elements(spark, d)).select("doc_id", "seq", "weight").orderBy(F.desc("weight"), "doc_id", "seq").limit(25)


@query(f"""{_E}, ew AS (SELECT section, unnest({_WORDS}) AS word FROM elements), s AS (SELECT section, word, count(*) AS n FROM ew GROUP BY 1, 2), tf AS (SELECT word, sum(n) AS tf FROM s GROUP BY 1), z AS (SELECT section, sum(n) AS size FROM s GROUP BY 1), total AS (SELECT sum(tf) AS t FROM tf),
c AS (SELECT section, -sum(n / size * log2(n / size)) AS h, -sum(tf / t * log2(n / size)) AS x FROM s JOIN tf USING (word) JOIN z USING (section), total GROUP BY 1) SELECT section, round(h, 5) AS entropy, round(x, 5) AS "cross", round(h + x, 5) AS conditional FROM c""")
def section_conditional_entropy(spark: SparkSession, d: str) -> DataFrame:
    return E.section_cross_entropy(elements(spark, d)).select("section", *(F.round(c, 5).alias(c) for c in ("entropy", "cross", "conditional")))


_PAGES = f"""{_E}, pages0 AS (SELECT doc_id, page, count(*) AS n, count(*) FILTER (type = 'text') / count(*) AS text, count(*) FILTER (type = 'table') / count(*) AS tab, count(*) FILTER (type = 'heading') / count(*) AS head, count(*) FILTER (type = 'table') AS tables,
  count(*) FILTER (type = 'heading') AS headings, round(sum({_AREA}), 9) AS total_area, sum(length(content)) AS chars, string_agg(content, ' ' ORDER BY seq) FILTER (content <> '') AS content FROM elements GROUP BY 1, 2),
pages1 AS (SELECT *, CASE WHEN total_area > 0 THEN chars / greatest(1, total_area) ELSE 0 END AS density, {_HASH} AS content_hash FROM pages0),
pages2 AS (SELECT *, CAST([text, tab, 0, head, 0, 0, 0, least(1, tables / 5), 0, least(1, headings / 5), least(1, total_area / n * 2), least(1, total_area), least(1, density / 1000), least(1, n / 50), 0, 0] AS DOUBLE[]) AS raw FROM pages1),
page_signatures AS (SELECT * EXCLUDE (raw), list_transform(raw, lambda x: round(x / sqrt(list_dot_product(raw, raw)), 9)) AS signature FROM pages2)"""


@query(f"{_PAGES} SELECT doc_id, page, n AS elements, tables, headings, round(total_area, 6) AS total_area, round(density, 3) AS text_density, content_hash, list_transform(signature, lambda x: round(x, 5)) AS signature FROM page_signatures")
def page_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    p = E.page_signatures(elements(spark, d))
    return p.select("doc_id", "page", "elements", "tables", "headings", F.round("total_area", 6).alias("total_area"), F.round("text_density", 3).alias("text_density"), "content_hash", F.transform("signature", lambda x: F.round(x, 5)).alias("signature"))


#: Pages meet by their document; equal signatures of a document are one node, so copies of a page are not paired.
def _templates(spark: SparkSession, d: str, least: float) -> DataFrame:
    """(doc_id, page, template): pages whose signatures chain by a cosine of at least ``least``, two pages or more."""
    pages = G.written(E.page_signatures(elements(spark, d)).select("doc_id", "page", "signature"), "signatures")
    kinds = pages.groupBy("doc_id", "signature").agg(F.min("page").alias("first"), F.count("*").alias("n"))
    a, b = (kinds.select("doc_id", F.col("first").alias(x), F.col("signature").alias(f"{x}s")) for x in ("a", "b"))
    key = lambda c: F.concat_ws(":", F.col("doc_id").cast("string"), F.lpad(F.col(c).cast("string"), 9, "0"))
    near = a.join(b, "doc_id").where("a < b").where(F.round(V.dot(F.col("as"), F.col("bs")), 7) >= least)
    linked = G.components(near.select(key("a").alias("src"), key("b").alias("dst")))
    of = kinds.withColumn("node", key("first")).join(linked, "node", "left").where(F.col("component").isNotNull() | (F.col("n") > 1))
    of = of.select("doc_id", "signature", F.coalesce(F.substring_index("component", ":", -1).cast("int"), "first").alias("template"))
    return pages.join(of, ["doc_id", "signature"]).select("doc_id", "page", "template")


def _templates_sql(least: float) -> str:
    return f"""WITH RECURSIVE {_PAGES.removeprefix('WITH ')}, near AS (SELECT a.doc_id, a.page AS a, b.page AS b FROM page_signatures a JOIN page_signatures b ON a.doc_id = b.doc_id AND a.page <> b.page AND round(list_dot_product(a.signature, b.signature), 7) >= {least}),
reach AS (SELECT doc_id, a AS page, a AS other FROM (SELECT DISTINCT doc_id, a FROM near) UNION SELECT r.doc_id, r.page, n.b FROM reach r JOIN near n ON n.doc_id = r.doc_id AND n.a = r.other),
templates AS (SELECT doc_id, page, CAST(min(other) AS INTEGER) AS template FROM reach GROUP BY 1, 2)"""


@query(f"{_templates_sql(0.85)} SELECT doc_id, page, template FROM templates")
def page_template_families(spark: SparkSession, d: str) -> DataFrame:
    return _templates(spark, d, 0.85)


@query(f"{_templates_sql(0.95)} SELECT doc_id, template, count(*) AS pages FROM templates GROUP BY 1, 2")
def duplicate_pages(spark: SparkSession, d: str) -> DataFrame:
    return _templates(spark, d, 0.95).groupBy("doc_id", "template").agg(F.count("*").alias("pages"))


@query(f"""{_templates_sql(0.85)}, p AS (SELECT doc_id, count(*) AS pages FROM page_signatures GROUP BY 1), t AS (SELECT doc_id, count(DISTINCT template) AS templates, count(*) AS covered FROM templates GROUP BY 1)
SELECT doc_id, pages, coalesce(templates, 0) AS templates, coalesce(covered, 0) AS covered, round((pages - coalesce(covered, 0) + coalesce(templates, 0)) / pages, 6) AS factor, round(100 * (coalesce(covered, 0) - coalesce(templates, 0)) / pages, 4) AS savings_pct FROM p LEFT JOIN t USING (doc_id)""")
def template_compression(spark: SparkSession, d: str) -> DataFrame:
    pages = E.page_signatures(elements(spark, d)).groupBy("doc_id").agg(F.count("*").alias("pages"))
    t = _templates(spark, d, 0.85).groupBy("doc_id").agg(F.count_distinct("template").alias("templates"), F.count("*").alias("covered"))
    j = pages.join(t, "doc_id", "left").na.fill(0, ["templates", "covered"])
    return j.select("doc_id", "pages", "templates", "covered", F.round((F.col("pages") - F.col("covered") + F.col("templates")) / F.col("pages"), 6).alias("factor"), F.round(100 * (F.col("covered") - F.col("templates")) / F.col("pages"), 4).alias("savings_pct"))


#: A template is dominant in a document if it covers half of its pages; boilerplate there is text of three copies or more.
@query(f"""{_templates_sql(0.85)}, p AS (SELECT doc_id, count(*) AS pages FROM page_signatures GROUP BY 1), big AS (SELECT doc_id, template, 2 * count(*) >= any_value(pages) AS dominant FROM templates JOIN p USING (doc_id) GROUP BY 1, 2),
h AS (SELECT {_HASH} AS hash, count(*) AS copies FROM elements WHERE trim(content) <> '' GROUP BY 1)
SELECT e.doc_id, seq, CAST(CASE WHEN t.template IS NULL THEN 0.6 WHEN dominant AND coalesce(copies, 0) >= 3 THEN 0.15 ELSE 0.7 END AS DOUBLE) AS score FROM elements e LEFT JOIN templates t ON t.doc_id = e.doc_id AND t.page = e.page LEFT JOIN big ON big.doc_id = t.doc_id AND big.template = t.template LEFT JOIN h ON h.hash = {_HASH.replace('content', 'e.content')} AND trim(e.content) <> ''""")
def template_scores(spark: SparkSession, d: str) -> DataFrame:
    from docweave.functions import text as T

    e = elements(spark, d)
    t = G.written(_templates(spark, d, 0.85), "templates")
    pages = e.groupBy("doc_id").agg(F.count_distinct("page").alias("pages"))
    big = t.groupBy("doc_id", "template").agg(F.count("*").alias("n")).join(pages, "doc_id").select("doc_id", "template", (2 * F.col("n") >= F.col("pages")).alias("dominant"))
    h = E.recurrence(e).select("hash", "copies")
    marked = e.withColumn("hash", F.when(F.trim("content") != "", T.normal_hash(F.col("content")))).join(t, ["doc_id", "page"], "left").join(big, ["doc_id", "template"], "left").join(h, "hash", "left")
    return marked.select("doc_id", "seq", F.when(F.col("template").isNull(), 0.6).when(F.col("dominant") & (F.coalesce("copies", F.lit(0)) >= 3), 0.15).otherwise(0.7).alias("score"))


_REC = f"{_E}, h AS (SELECT {_HASH} AS hash, count(*) AS copies, count(DISTINCT (doc_id, page)) AS pages, min(type) AS type FROM elements WHERE trim(content) <> '' GROUP BY 1)"


@query(f"{_REC} SELECT type, count(*) AS groups, CAST(sum(copies) AS BIGINT) AS elements, count(*) FILTER (copies >= 3) AS template_groups, max(copies) AS most, round(avg(copies), 4) AS mean FROM h GROUP BY 1")
def recurrence_by_type(spark: SparkSession, d: str) -> DataFrame:
    return E.recurrence(elements(spark, d)).groupBy("type").agg(F.count("*").alias("groups"), F.sum("copies").alias("elements"), F.count_if(F.col("copies") >= 3).alias("template_groups"), F.max("copies").alias("most"), F.round(F.avg("copies"), 4).alias("mean"))


@query(f"{_REC} SELECT count(*) AS groups, CAST(sum(copies) AS BIGINT) AS elements, count(*) FILTER (copies >= 3) AS template_groups, round(count(*) / sum(copies), 6) AS avg_compression, CAST((sum(copies) - count(*)) * 200 AS BIGINT) AS bytes_saved, round((count(*) + 0.1 * sum(copies)) / sum(copies), 6) AS reference_ratio FROM h")
def recurrence_compression(spark: SparkSession, d: str) -> DataFrame:
    g = E.recurrence(elements(spark, d)).agg(F.count("*").alias("g"), F.sum("copies").alias("n"), F.count_if(F.col("copies") >= 3).alias("template_groups"))
    return g.select(F.col("g").alias("groups"), F.col("n").alias("elements"), "template_groups", F.round(F.col("g") / F.col("n"), 6).alias("avg_compression"), ((F.col("n") - F.col("g")) * 200).alias("bytes_saved"), F.round((F.col("g") + 0.1 * F.col("n")) / F.col("n"), 6).alias("reference_ratio"))


@query(f"{_REC} SELECT doc_id, seq, CAST(CASE WHEN copies >= 3 THEN 0.15 WHEN copies = 2 THEN 0.4 ELSE 0.9 END AS DOUBLE) AS score FROM elements e LEFT JOIN h ON h.hash = {_HASH.replace('content', 'e.content')} AND trim(e.content) <> ''")
def recurrence_scores(spark: SparkSession, d: str) -> DataFrame:
    from docweave.functions import text as T

    e = elements(spark, d)
    marked = e.withColumn("hash", F.when(F.trim("content") != "", T.normal_hash(F.col("content")))).join(E.recurrence(e), "hash", "left")
    return marked.select("doc_id", "seq", F.when(F.col("copies") >= 3, 0.15).when(F.col("copies") == 2, 0.4).otherwise(0.9).alias("score"))


@query(f"{_REC} SELECT hash, copies, pages FROM h WHERE copies >= 2")
def repeated_content_pages(spark: SparkSession, d: str) -> DataFrame:
    return E.recurrence(elements(spark, d)).where("copies >= 2").select("hash", "copies", "pages")


@query(f"""{_REC} SELECT 'template' AS kind, hash, copies, CAST(NULL AS BIGINT) AS doc_id, CAST(NULL AS BIGINT) AS seq FROM h WHERE copies >= 3
UNION ALL SELECT 'element', {_HASH.replace('content', 'e.content')}, copies, doc_id, seq FROM elements e JOIN h ON h.hash = {_HASH.replace('content', 'e.content')} AND trim(e.content) <> '' WHERE copies < 3""")
def compressed_storage(spark: SparkSession, d: str) -> DataFrame:
    from docweave.functions import text as T

    e, none = elements(spark, d), F.lit(None).cast("long")
    g = E.recurrence(e)
    alone = e.where(F.trim("content") != "").withColumn("hash", T.normal_hash(F.col("content"))).join(g.select("hash", "copies"), "hash").where("copies < 3")
    return g.where("copies >= 3").select(F.lit("template").alias("kind"), "hash", "copies", none.alias("doc_id"), none.alias("seq")).unionByName(alone.select(F.lit("element").alias("kind"), "hash", "copies", "doc_id", "seq"))


_GROUPS = f"""{_E}, grp AS (SELECT t.doc_id, t.seq AS anchor, list_sort(list(o.seq)) AS members FROM elements t JOIN elements o ON o.doc_id = t.doc_id AND o.seq <> t.seq WHERE t.type = 'table' AND (o.type = 'caption' OR (o.type = 'text' AND regexp_matches(lower(o.content), '{E.TABLE_WORDS}')))
  AND round(greatest(0, greatest(t.y0, o.y0) - least(t.y1, o.y1)), 9) <= 0.12 GROUP BY 1, 2)"""


@query(f"{_GROUPS} SELECT doc_id, anchor, CAST(len(members) + 1 AS INTEGER) AS size, members FROM grp")
def table_groups(spark: SparkSession, d: str) -> DataFrame:
    return E.table_groups(elements(spark, d)).select("doc_id", "anchor", (F.size("members") + 1).alias("size"), "members")


@query(f"""{_GROUPS}, m AS (SELECT doc_id, anchor, unnest(list_prepend(anchor, members)) AS seq FROM grp), hit AS (SELECT DISTINCT doc_id, anchor FROM m WHERE seq % 2 = 1)
SELECT doc_id, seq, CAST(CASE WHEN seq % 2 = 1 THEN 1 ELSE 0.6 * 0.9 END AS DOUBLE) AS score FROM m JOIN hit USING (doc_id, anchor) GROUP BY 1, 2""")
def group_scores(spark: SparkSession, d: str) -> DataFrame:
    e = elements(spark, d)
    return E.group_scores(E.table_groups(e), e.where("seq % 2 = 1"))


@query(f"{_E} SELECT doc_id, seq, CAST(round(least(1, CAST(0.5 AS DOUBLE) + CASE WHEN page IN (2, 5) THEN 0.3 WHEN page IN (1, 3, 4, 6) THEN 0.1 ELSE 0 END + CASE WHEN contains(lower(section), 'web') THEN 0.2 ELSE 0 END + CASE WHEN type = 'table' THEN 0.1 ELSE 0 END + CASE WHEN (y0 + y1) / 2 > 0.1 AND (y0 + y1) / 2 < 0.9 THEN 0.05 ELSE 0 END), 6) AS DOUBLE) AS score FROM elements")
def geometry_relevance(spark: SparkSession, d: str) -> DataFrame:
    return elements(spark, d).select("doc_id", "seq", F.round(E.relevance([2, 5], "web"), 6).alias("score"))


@query(f"{_E} SELECT a.doc_id, a.page, a.seq AS a_seq, b.seq AS b_seq, CASE WHEN round(a.y1, 9) <= round(b.y0, 9) THEN 'ABOVE' ELSE 'BELOW' END AS edge FROM elements a JOIN elements b ON a.doc_id = b.doc_id AND a.page = b.page AND a.seq <> b.seq WHERE round(a.y1, 9) <= round(b.y0, 9) OR round(b.y1, 9) <= round(a.y0, 9)")
def spatial_edges(spark: SparkSession, d: str) -> DataFrame:
    p = L.page_pairs(elements(spark, d))
    above = F.round("a_y1", 9) <= F.round("b_y0", 9)
    return p.where(above | (F.round("b_y1", 9) <= F.round("a_y0", 9))).select(F.col("a_doc_id").alias("doc_id"), F.col("a_page").alias("page"), "a_seq", "b_seq", F.when(above, "ABOVE").otherwise("BELOW").alias("edge"))
