"""What recurs at a place in documents, and in the whole corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.operators import recurrence as R
from docweave.plans.base import query
from docweave.sources.relations import ELEMENTS_SQL, elements


def placed_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements, where lines without text stand for figures."""
    blank = F.trim(F.regexp_replace("content", r"\s+", " ")) == ""
    return elements(spark, sf_dir).withColumn("type", F.when(blank, "figure").otherwise(F.col("type")))


def groups(members: DataFrame, scope: list[str]) -> DataFrame:
    return members.groupBy(*scope, "kind", "key", "place").agg(F.first("first").alias("first"), F.first("members").alias("members"), F.first("pages").alias("pages"))


def _members_sql(scope: str) -> str:
    """(doc_id, seq, page, kind, key, first_doc, first_seq, members, pages); all pairs of near elements, closed by recursion."""
    same = f"a.kind = b.kind AND a.key = b.key{' AND a.doc_id = b.doc_id' if scope else ''}"
    return f"""
WITH RECURSIVE {ELEMENTS_SQL},
e AS (SELECT * REPLACE (CASE WHEN trim(regexp_replace(content, '\\s+', ' ', 'g')) = '' THEN 'figure' ELSE type END AS type) FROM elements),
n AS (SELECT *, trim(regexp_replace(lower(content), '\\s+', ' ', 'g')) AS norm, string_split(content, chr(10))[1:3] AS top FROM e),
k AS (SELECT *, list_filter([CASE WHEN y0 < 0.08 AND type IN ('heading', 'text') THEN 'header' END, CASE WHEN y1 > 0.92 AND type IN ('text', 'caption') THEN 'footer' END,
    CASE WHEN type = 'figure' AND (x1 - x0) * (y1 - y0) < 0.05 THEN 'logo' END, CASE WHEN type = 'table' THEN 'table' END], lambda x: x IS NOT NULL) AS kinds FROM n),
c AS (SELECT doc_id, seq, page, unnest(CASE WHEN len(kinds) > 0 THEN kinds WHEN norm <> '' THEN ['duplicate'] ELSE [] END) AS kind, norm, top, CAST(round(x0 * 1000000) AS BIGINT) AS x, CAST(round(y0 * 1000000) AS BIGINT) AS y FROM k),
r AS (SELECT doc_id, seq, page, kind, x, y, CASE WHEN kind = 'table' THEN list_max(list_transform(top, lambda s: length(s) - length(replace(s, '|', '')))) || '_' || sha256(top[1]) ELSE sha256(norm) END AS key FROM c),
spot AS (SELECT DISTINCT {scope} kind, key, x, y FROM r WHERE kind IN ('header', 'footer', 'logo')),
link AS (SELECT a.*, b.x AS bx, b.y AS by_ FROM spot a JOIN spot b ON {same} WHERE abs(a.x - b.x) < 50000 AND abs(a.y - b.y) < 50000),
reach AS (SELECT {scope} kind, key, x, y, x AS rx, y AS ry FROM spot
  UNION SELECT {'l.doc_id, ' if scope else ''}l.kind, l.key, l.bx, l.by_, q.rx, q.ry FROM reach q JOIN link l ON l.kind = q.kind AND l.key = q.key{' AND l.doc_id = q.doc_id' if scope else ''} AND l.x = q.x AND l.y = q.y),
root AS (SELECT {scope} kind, key, x, y, min((rx, ry)) AS place FROM reach GROUP BY ALL),
m AS (SELECT r.*, root.place FROM r LEFT JOIN root ON r.kind = root.kind AND r.key = root.key AND r.x = root.x AND r.y = root.y{' AND r.doc_id = root.doc_id' if scope else ''}),
g AS (SELECT {scope} kind, key, place, min((doc_id, seq)) AS first, count(*) AS members, count(DISTINCT page) AS pages FROM m GROUP BY ALL),
kept AS (SELECT * FROM g WHERE kind <> 'duplicate' OR members >= 2)"""


_OF_DOC, _OF_ALL = _members_sql("doc_id,"), _members_sql("")


@query(f"""{_OF_DOC}
SELECT doc_id, kind || '-' || row_number() OVER (PARTITION BY doc_id, kind ORDER BY first, key) AS recurrence_id, struct_extract_at(first, 2) AS first_seq, members, pages, members >= 3 AS is_template, members >= 5 AS is_dominant,
  round(CAST(1 AS DOUBLE) / members, 9) AS compression_ratio FROM kept""")
def recurrence_groups(spark: SparkSession, d: str) -> DataFrame:
    members = R.recurrence(placed_elements(spark, d), ["doc_id"], ["seq"])
    g = R.numbered(groups(members, ["doc_id"]), ["doc_id"])
    return g.select("doc_id", "recurrence_id", F.col("first.seq").alias("first_seq"), "members", "pages", (F.col("members") >= R.TEMPLATE).alias("is_template"), (F.col("members") >= R.DOMINANT).alias("is_dominant"), F.round(F.lit(1.0) / F.col("members"), 9).alias("compression_ratio"))


@query(f"""{_OF_DOC},
own AS (SELECT m.doc_id, m.seq, max_by({{'kind': m.kind, 'n': kept.members}}, list_position(['header', 'footer', 'logo', 'table', 'duplicate'], m.kind)) AS own
  FROM m JOIN kept ON m.doc_id = kept.doc_id AND m.kind = kept.kind AND m.key = kept.key AND m.place IS NOT DISTINCT FROM kept.place GROUP BY ALL)
SELECT doc_id, seq, own.kind AS kind, coalesce(own.n, 1) AS frequency, coalesce(own.n >= 3, false) OR (y0 + y1) / 2 < 0.08 OR (y0 + y1) / 2 > 0.92 AS is_template FROM e LEFT JOIN own USING (doc_id, seq)""")
def recurring_elements(spark: SparkSession, d: str) -> DataFrame:
    e = placed_elements(spark, d)
    return R.marked(e, R.recurrence(e, ["doc_id"], ["seq"]), ["doc_id"], ["seq"]).select("doc_id", "seq", "kind", "frequency", "is_template")


@query(f"""{_OF_DOC}
SELECT doc_id, count(*) AS groups, count(*) FILTER (members >= 3) AS templates, CAST(sum(members) AS BIGINT) AS elements, round(CAST(count(*) AS DOUBLE) / sum(members), 9) AS avg_compression, CAST((sum(members) - count(*)) * 200 AS BIGINT) AS saved_bytes FROM kept GROUP BY doc_id""")
def recurrence_savings(spark: SparkSession, d: str) -> DataFrame:
    members = R.recurrence(placed_elements(spark, d), ["doc_id"], ["seq"])
    return R.savings(groups(members, ["doc_id"]), ["doc_id"]).withColumn("avg_compression", F.round("avg_compression", 9))


@query(f"""{_OF_ALL}
SELECT kind, key, struct_extract_at(first, 1) AS first_doc, struct_extract_at(first, 2) AS first_seq, members, (SELECT count(DISTINCT m.doc_id) FROM m WHERE m.kind = kept.kind AND m.key = kept.key AND m.place IS NOT DISTINCT FROM kept.place) AS documents FROM kept WHERE members >= 3""")
def corpus_templates(spark: SparkSession, d: str) -> DataFrame:
    """Groups of three elements or more over all documents, as page furniture of a site has them."""
    members = R.recurrence(placed_elements(spark, d), [], ["doc_id", "seq"])
    g = members.groupBy("kind", "key", "place").agg(F.first("first").alias("first"), F.first("members").alias("members"), F.count_distinct("doc_id").alias("documents"))
    return g.where(F.col("members") >= R.TEMPLATE).select("kind", "key", F.col("first.doc_id").alias("first_doc"), F.col("first.seq").alias("first_seq"), "members", "documents")
