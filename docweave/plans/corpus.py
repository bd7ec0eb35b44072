"""Reports on the corpus, selections under a budget, citations of pages, and places of elements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.functions import text as T
from docweave.operators import compliance as C
from docweave.operators import layout as L
from docweave.operators.graphs import parts_for
from docweave.plans.base import query
from docweave.plans.compliance import _ENTITIES, _FAMILIES
from docweave.sources.relations import EDGES_SQL, ELEMENTS_SQL, edges, elements, table

_E = f"WITH {ELEMENTS_SQL}"

#: Line items of a task, about.
REFERENCES = 1 << 20


@query(f"""WITH {EDGES_SQL}, d AS (SELECT count(*) AS documents, avg(n_chars) AS mean_chars, count(*) FILTER (n_chars = 0) AS empty FROM documents), g AS (SELECT count(*) AS m FROM edges), n AS (SELECT count(*) AS n FROM (SELECT src FROM edges UNION SELECT dst FROM edges)),
v AS (SELECT count(*) FILTER (event_type = 'click') / CAST(greatest(1, count(*) FILTER (event_type = 'view')) AS DOUBLE) AS ctr, avg(1 / (1 + CAST(event_id % 10 AS DOUBLE))) FILTER (event_type = 'click') AS mrr FROM events)
SELECT documents, round(mean_chars, 3) AS mean_chars, empty, m AS edges, round(m / CAST(n AS DOUBLE) / (n - 1), 9) AS density, round(ctr, 6) AS ctr, round(mrr, 6) AS mrr FROM d, g, n, v""")
def corpus_health(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").agg(F.count("*").alias("documents"), F.round(F.avg("n_chars"), 3).alias("mean_chars"), F.count_if(F.col("n_chars") == 0).alias("empty"))
    e = edges(spark, d)
    ends = e.select(F.explode(F.array("src", "dst")).alias("node")).distinct().agg(F.count("*").alias("n"))
    click = F.col("event_type") == "click"
    v = table(spark, d, "events").agg(F.round(F.count_if(click) / F.greatest(F.lit(1), F.count_if(F.col("event_type") == "view")), 6).alias("ctr"), F.round(F.avg(F.when(click, 1 / (1 + F.col("event_id") % 10))), 6).alias("mrr"))
    one_row = docs.crossJoin(e.agg(F.count("*").alias("edges"))).crossJoin(ends).crossJoin(v)  # four one-row aggregates
    return one_row.select("documents", "mean_chars", "empty", "edges", F.round(F.try_divide(F.try_divide("edges", "n"), F.col("n") - 1), 9).alias("density"), "ctr", "mrr")


@query(f"SELECT type, count(*) AS mentions, count(DISTINCT entity) AS entities, count(DISTINCT doc_id) AS documents FROM ({_ENTITIES}) GROUP BY 1")
def semantic_statistics(spark: SparkSession, d: str) -> DataFrame:
    e = C.entities(table(spark, d, "documents"), "doc_id", "text", _FAMILIES)
    return e.groupBy("type").agg(F.count("*").alias("mentions"), F.count_distinct("entity").alias("entities"), F.count_distinct("doc_id").alias("documents"))


@query(f"SELECT doc_id, type || ':' || entity AS node FROM ({_ENTITIES}) GROUP BY 1, 2")
def entity_nodes(spark: SparkSession, d: str) -> DataFrame:
    return C.entities(table(spark, d, "documents"), "doc_id", "text", _FAMILIES).select("doc_id", F.concat_ws(":", "type", "entity").alias("node")).distinct()


@query("SELECT 'o' || l_orderkey AS src, 'p' || l_partkey AS dst, 'REFERS_TO' AS edge_type, count(*) AS mentions FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey GROUP BY 1, 2")
def reference_edges(spark: SparkSession, d: str) -> DataFrame:
    refs = table(spark, d, "lineitem").select("l_orderkey", "l_partkey").where("l_orderkey IS NOT NULL AND l_partkey IS NOT NULL")
    n = parts_for(spark, refs.count(), REFERENCES)
    pair = refs.repartition(n, "l_orderkey").groupBy("l_orderkey", "l_partkey").agg(F.count("*").alias("mentions"))
    pair = pair.join(table(spark, d, "orders").repartition(n, "o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"), "left_semi")
    pair = pair.repartition(n, "l_partkey").join(table(spark, d, "part").repartition(n, "p_partkey"), F.col("l_partkey") == F.col("p_partkey"), "left_semi")
    return pair.select(F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("src"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("dst"), F.lit("REFERS_TO").alias("edge_type"), "mentions")


@query(f"{_E} SELECT a.doc_id, a.page, a.seq AS a_seq, b.seq AS b_seq, round((greatest(0, 1 - abs((a.x0 + a.x1) / 2 - (b.x0 + b.x1) / 2)) + greatest(0, 1 - abs((a.y0 + a.y1) / 2 - (b.y0 + b.y1) / 2))) / 2, 6) AS alignment FROM elements a JOIN elements b ON a.doc_id = b.doc_id AND a.page = b.page AND a.seq <> b.seq")
def element_alignments(spark: SparkSession, d: str) -> DataFrame:
    p = L.page_pairs(elements(spark, d))
    centre = lambda s, axis: (F.col(f"{s}_{axis}0") + F.col(f"{s}_{axis}1")) / 2
    on = lambda axis: F.greatest(F.lit(0.0), 1 - F.abs(centre("a", axis) - centre("b", axis)))
    return p.select(F.col("a_doc_id").alias("doc_id"), F.col("a_page").alias("page"), "a_seq", "b_seq", F.round((on("x") + on("y")) / 2, 6).alias("alignment"))


@query(f"{_E} SELECT doc_id, seq, doc_id || '/' || page || '/' || section || '/' || seq AS path, round(x0 / 1.3, 6) AS nx, round(y0 / 1.1, 6) AS ny, CASE WHEN length(content) >= 200 THEN 1 WHEN length(content) >= 80 THEN 2 ELSE 3 END AS level FROM elements")
def element_places(spark: SparkSession, d: str) -> DataFrame:
    """Paths, boxes as shares of a page of 1.3 x 1.1, and levels by size."""
    size = F.length("content")
    return elements(spark, d).select("doc_id", "seq", F.concat_ws("/", F.col("doc_id").cast("string"), F.col("page").cast("string"), "section", F.col("seq").cast("string")).alias("path"), F.round(F.col("x0") / 1.3, 6).alias("nx"), F.round(F.col("y0") / 1.1, 6).alias("ny"), F.when(size >= 200, 1).when(size >= 80, 2).otherwise(3).alias("level"))


_TOKENS = r"greatest(1, CAST(floor(len(list_filter(string_split(trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')), ' '), lambda w: w <> '')) / CAST(0.75 AS DOUBLE)) AS INTEGER))"


@query(f"SELECT doc_id, {_TOKENS} AS tokens FROM documents ORDER BY tokens DESC, doc_id LIMIT 20")
def largest_texts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.tokens_by_words(F.col("text")).alias("tokens")).orderBy(F.desc("tokens"), "doc_id").limit(20)


_NORM = r"lower(trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')))"


@query(f"""WITH u AS (SELECT source, arg_min(text, doc_id) AS text, min(doc_id) AS doc_id FROM documents GROUP BY source, {_NORM}), t AS (SELECT source, doc_id, CAST({_TOKENS} AS BIGINT) AS tokens FROM u), r AS (SELECT *, sum(tokens) OVER (PARTITION BY source ORDER BY tokens DESC, doc_id ROWS UNBOUNDED PRECEDING) AS held FROM t),
o AS (SELECT source, sum(CAST({_TOKENS} AS BIGINT)) AS original FROM documents GROUP BY 1)
SELECT source, CAST(any_value(original) AS BIGINT) AS original, count(*) AS texts, CAST(sum(tokens) AS BIGINT) AS tokens FROM r JOIN o USING (source) WHERE held <= original * 0.5 OR held = tokens GROUP BY 1""")
def optimized_context(spark: SparkSession, d: str) -> DataFrame:
    """For each source: equal texts once, then the longest within half of its tokens (one text at least)."""
    from docweave.operators.ranks import below

    docs = table(spark, d, "documents").select("source", "doc_id", "text", T.tokens_by_words(F.col("text")).cast("long").alias("tokens"))
    original = docs.groupBy("source").agg(F.sum("tokens").alias("original"))
    once = docs.groupBy("source", F.lower(T.collapsed(F.col("text"))).alias("norm")).agg(F.min(F.struct("doc_id", "tokens")).alias("m")).select("source", "m.doc_id", "m.tokens")
    at = F.struct("source", (-F.col("tokens")).alias("t"), "doc_id").alias("at")
    held = below(once.select(at, "tokens"), "at", "tokens")  # running sums by ranges
    start = held.groupBy("at.source").agg(F.min("below").alias("start"))
    j = held.select("at.source", "n", "below").join(F.broadcast(start), "source").join(F.broadcast(original), "source")
    upto = F.col("below") - F.col("start") + F.col("n")
    return j.where((upto <= F.col("original") * 0.5) | (F.col("below") == F.col("start"))).groupBy("source").agg(F.first("original").alias("original"), F.count("*").alias("texts"), F.sum("n").alias("tokens"))


_CITED = f"""{_E}, pages AS (SELECT doc_id, page, string_agg(content, chr(10) ORDER BY seq) AS body FROM elements GROUP BY 1, 2), whole AS (SELECT doc_id, string_agg(body, chr(10) ORDER BY page) AS body FROM pages GROUP BY 1),
cited AS (SELECT doc_id, seq, CASE WHEN seq % 3 = 1 THEN page + 1 ELSE page END AS page, CASE WHEN seq % 5 = 4 THEN 'nothing like it' ELSE substr(content, 1, 30) END AS excerpt FROM elements WHERE length(content) >= 30)"""


@query(f"""{_CITED} SELECT c.doc_id, seq, CASE WHEN p.body IS NULL THEN 'missing' WHEN contains(p.body, excerpt) THEN 'exact_match' WHEN contains(w.body, excerpt) THEN 'partial_match' ELSE 'no_match' END AS status FROM cited c LEFT JOIN pages p ON p.doc_id = c.doc_id AND p.page = c.page JOIN whole w ON w.doc_id = c.doc_id""")
def citation_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Excerpts held against the page that they cite, then against the document's other pages."""
    e = elements(spark, d)
    cited = e.where("length(content) >= 30").select("doc_id", "seq", F.when(F.col("seq") % 3 == 1, F.col("page") + 1).otherwise(F.col("page")).alias("page"), F.when(F.col("seq") % 5 == 4, "nothing like it").otherwise(F.substring("content", 1, 30)).alias("excerpt"))
    return C.checked_citations(cited, e)


@query("SELECT CAST(c_nationkey % 4 AS INTEGER) AS level, count(*) AS items, CAST(sum(length(c_name)) AS BIGINT) AS bytes, round(avg(c_acctbal), 4) AS mean_weight FROM customer GROUP BY 1")
def memory_levels(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").groupBy((F.col("c_nationkey") % 4).cast("int").alias("level")).agg(F.count("*").alias("items"), F.sum(F.length("c_name")).alias("bytes"), F.round(F.avg("c_acctbal"), 4).alias("mean_weight"))


@query("WITH a AS (SELECT user_id, list_sort(list_distinct(list(event_id % 50))) AS cited FROM events GROUP BY 1) SELECT user_id, CAST(len(cited) AS INTEGER) AS n FROM a WHERE NOT list_contains(cited, 17)")
def entries_without_document(spark: SparkSession, d: str) -> DataFrame:
    """Cache entries that stay once those that cite a document go."""
    a = table(spark, d, "events").groupBy("user_id").agg(F.collect_set(F.col("event_id") % 50).alias("cited"))
    return a.where(~F.array_contains("cited", F.lit(17).cast("long"))).select("user_id", F.size("cited").alias("n"))


@query("SELECT user_id, count(*) AS failures, max(event_id) AS last_event FROM events WHERE event_type = 'error' GROUP BY 1 HAVING count(*) >= 3")
def dead_letters(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").where("event_type = 'error'").groupBy("user_id").agg(F.count("*").alias("failures"), F.max("event_id").alias("last_event")).where("failures >= 3")


@query("SELECT user_id, CAST(greatest(0, 20 - count(*) FILTER (ts > (SELECT max(ts) FROM events) - INTERVAL 24 HOUR)) AS BIGINT) AS remaining FROM events GROUP BY 1")
def limiter_status(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    last = e.agg(F.max("ts").alias("last"))
    recent = F.count_if(F.col("ts") > F.col("last") - F.expr("INTERVAL 24 HOURS"))
    return e.crossJoin(F.broadcast(last)).groupBy("user_id").agg(F.greatest(F.lit(0), 20 - recent).alias("remaining"))  # one row
