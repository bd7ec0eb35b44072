"""Screening of documents, versions of customers, audit chains of events, scores of labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.operators import compliance as C
from docweave.plans.base import query
from docweave.sources.relations import table


def docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


@query("SELECT doc_id, " + ", ".join(f"CAST(len(regexp_extract_all(text, '{p}')) AS INTEGER) AS {k}" for k, p in C.PII.items()) + " FROM documents")
def pii_scan_counts(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select("doc_id", *(c.alias(k) for k, c in C.pii_counts(F.col("text")).items()))


_RED = "text"
for _k, _p in C.PII.items():
    _RED = f"regexp_replace({_RED}, '{_p}', '<{_k.upper()}_REDACTED>', 'g')"


@query(f"SELECT doc_id, sha256({_RED}) AS redacted_hash, len(regexp_extract_all({_RED}, '_REDACTED>')) AS n FROM documents")
def redacted_texts(spark: SparkSession, d: str) -> DataFrame:
    r = docs(spark, d).select("doc_id", C.redacted(F.col("text")).alias("r"))
    return r.select("doc_id", F.sha2(F.col("r").cast("binary"), 256).alias("redacted_hash"), F.size(F.regexp_extract_all("r", F.lit("(_REDACTED>)"), F.lit(1))).cast("long").alias("n"))


_THREAT = " UNION ALL ".join(f"SELECT doc_id, '{k}' AS threat, '{s}' AS severity, regexp_extract(lower(text), '{p}', 1) AS found FROM documents" for k, (s, p) in C.THREATS.items())


@query(f"SELECT * FROM ({_THREAT}) WHERE found <> ''")
def threat_scan(spark: SparkSession, d: str) -> DataFrame:
    return C.threats(docs(spark, d), "doc_id", "text")


@query("SELECT doc_id, CASE WHEN " + " OR ".join(f"regexp_matches(lower(text), '{p}')" for p in C.INJECTION) + " THEN 'reject' WHEN length(text) = 0 OR length(text) > 10000 THEN 'quarantine' ELSE 'pass' END AS verdict FROM documents")
def ingestion_gate(spark: SparkSession, d: str) -> DataFrame:
    return C.gate(docs(spark, d), "doc_id", "text", 10_000)


@query("WITH a AS (SELECT c_custkey, c_mktsegment AS v FROM customer WHERE c_custkey % 7 <> 0), b AS (SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'CHANGED' ELSE c_mktsegment END AS v FROM customer WHERE c_custkey % 11 <> 0) SELECT c_custkey, change FROM (SELECT coalesce(a.c_custkey, b.c_custkey) AS c_custkey, CASE WHEN a.c_custkey IS NULL THEN 'insert' WHEN b.c_custkey IS NULL THEN 'delete' WHEN a.v IS DISTINCT FROM b.v THEN 'update' END AS change FROM a FULL JOIN b ON a.c_custkey = b.c_custkey) WHERE change IS NOT NULL")
def version_diff(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("v"))
    new = c.where("c_custkey % 11 != 0").withColumn("v", F.when(F.col("c_custkey") % 5 == 0, "CHANGED").otherwise(F.col("v")))
    return C.version_diff(c.where("c_custkey % 7 != 0"), new, ["c_custkey"], "v")


_PAYLOAD = "concat_ws('|', CAST(event_id AS VARCHAR), event_type, props)"


_CHAIN = f"""WITH RECURSIVE o AS (SELECT event_id, user_id, {_PAYLOAD} AS payload, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nth FROM events),
c AS (SELECT event_id, user_id, nth, sha256('|' || payload) AS own, '' AS previous FROM o WHERE nth = 1 UNION ALL SELECT o.event_id, o.user_id, o.nth, sha256(c.own || '|' || payload), c.own FROM c JOIN o ON o.user_id = c.user_id AND o.nth = c.nth + 1)"""


@query(f"{_CHAIN} SELECT event_id, own, previous FROM c")
def audit_chain(spark: SparkSession, d: str) -> DataFrame:
    return C.chained(table(spark, d, "events"), "user_id", ["ts", "event_id"], F.concat_ws("|", F.col("event_id").cast("string"), "event_type", "props")).select("event_id", "own", "previous")


@query("SELECT event_id FROM events WHERE event_id % 1000 = 17")
def broken_audit_links(spark: SparkSession, d: str) -> DataFrame:
    """Events altered after they were chained show."""
    payload = F.concat_ws("|", F.col("event_id").cast("string"), "event_type", "props")
    chain = C.chained(table(spark, d, "events"), "user_id", ["ts", "event_id"], payload)
    altered = chain.withColumn("props", F.when(F.col("event_id") % 1000 == 17, "altered").otherwise(F.col("props")))
    return C.broken_links(altered, "user_id", ["ts", "event_id"], payload).select("event_id")


@query("SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, grouping(event_type) AS all_types FROM events GROUP BY GROUPING SETS ((event_type), ())")
def audit_statistics(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.groupingSets([[F.col("event_type")], []], F.col("event_type")).agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"), F.grouping("event_type").cast("long").alias("all_types"))


_LONG = r"list_distinct(list_filter(regexp_extract_all(lower({t}), '[\p{{L}}\p{{N}}_]+'), lambda x: length(x) >= 4))"


@query(f"WITH c AS (SELECT item_id AS id, {_LONG.format(t='text')} AS c FROM benchmark), s AS (SELECT doc_id AS id, {_LONG.format(t='text')} AS s FROM documents) SELECT id, round(x, 6) AS overlap, x >= 0.5 AS grounded FROM (SELECT id, CASE WHEN len(c) > 0 THEN len(list_intersect(c, coalesce(s, []))) / len(c) ELSE 0 END AS x FROM c LEFT JOIN s USING (id))")
def claim_grounding(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "benchmark").select(F.col("item_id").alias("id"), "text")
    return C.grounded(c, docs(spark, d).select(F.col("doc_id").alias("id"), "text"), "id", "text").withColumn("overlap", F.round("overlap", 6))


_SETS = "t AS (SELECT label, list(vec_id) FILTER (vec_id % 3 = 0) AS f, list(vec_id) FILTER (vec_id % 2 = 0) AS e FROM embeddings GROUP BY 1), s AS (SELECT label, len(list_intersect(f, e)) AS tp, len(list_filter(f, lambda x: NOT list_contains(e, x))) AS fp, len(list_filter(e, lambda x: NOT list_contains(f, x))) AS fn FROM t)"


@query(f"WITH {_SETS} SELECT label, CAST(tp AS INTEGER) AS tp, CAST(fp AS INTEGER) AS fp, CAST(fn AS INTEGER) AS fn, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall FROM s")
def precision_recall(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").groupBy("label").agg(F.collect_set(F.when(F.col("vec_id") % 3 == 0, F.col("vec_id"))).alias("f"), F.collect_set(F.when(F.col("vec_id") % 2 == 0, F.col("vec_id"))).alias("e"))
    s = e.select("label", *(c.alias(k) for k, c in C.set_scores(F.col("f"), F.col("e")).items()))
    return s.withColumn("precision", F.round(F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")), 6)).withColumn("recall", F.round(F.try_divide(F.col("tp"), F.col("tp") + F.col("fn")), 6))


_CONF = "n AS (SELECT quality AS t, toxic AS p, count(*) AS n FROM labels GROUP BY 1, 2), c AS (SELECT class, sum(s) AS support, sum(d) AS said, sum(tp) AS tp FROM (SELECT t AS class, n AS s, 0 AS d, CASE WHEN t = p THEN n ELSE 0 END AS tp FROM n UNION ALL SELECT p, 0, n, 0 FROM n) GROUP BY 1)"


@query(f"WITH {_CONF} SELECT class, CAST(support AS BIGINT) AS support, round(tp / said, 6) AS precision, round(tp / support, 6) AS recall, round(CASE WHEN tp > 0 THEN 2 * tp / (said + support) ELSE 0 END, 6) AS f1 FROM c")
def confusion_scores(spark: SparkSession, d: str) -> DataFrame:
    c = C.confusion(table(spark, d, "labels"), "quality", "toxic")
    return c.select("class", "support", *(F.round(x, 6).alias(x) for x in ("precision", "recall", "f1")))


_W = r"list_distinct(regexp_extract_all(lower({t}), '[\p{{L}}\p{{N}}_]+'))"


@query(f"WITH w AS (SELECT b.item_id AS id, {_W.format(t='b.text')} AS x, {_W.format(t='d.text')} AS y FROM benchmark b JOIN documents d ON b.item_id = d.doc_id) SELECT id, round(CASE WHEN len(list_intersect(x, y)) > 0 THEN 2 * len(list_intersect(x, y)) / (len(x) + len(y)) ELSE 0 END, 6) AS f1 FROM w")
def answer_token_f1(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("a"))
    return b.join(docs(spark, d).select(F.col("doc_id").alias("id"), "text"), "id").select("id", F.round(C.token_f1(F.col("a"), F.col("text")), 6).alias("f1"))


_CLAIMS = """
opening AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(string_split(text, chr(10))[1]), '[\\p{L}\\p{N}_]+')) AS w FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL),
claims AS (SELECT doc_id AS claim_id, w FROM opening WHERE doc_id % 2 = 0), known AS (SELECT doc_id AS known_id, w FROM opening WHERE doc_id % 2 = 1)"""


@query(f"""WITH {_CLAIMS}, s AS (SELECT claim_id, known_id, len(list_intersect(c.w, k.w)) / CAST(len(c.w) + len(k.w) - len(list_intersect(c.w, k.w)) AS DOUBLE) AS s FROM claims c, known k WHERE len(c.w) > 0 AND len(k.w) > 0),
b AS (SELECT claim_id, arg_min(known_id, (-round(s, 9), known_id)) AS known_id, max(s) AS s FROM s WHERE s >= 0.3 GROUP BY 1)
SELECT claim_id, known_id, round(coalesce(s, 0.5), 6) AS similarity, CASE WHEN s >= 0.75 THEN 'supported' WHEN s >= 0.4 THEN 'partially_supported' ELSE 'unverified' END AS status FROM claims LEFT JOIN b USING (claim_id)""")
def fact_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """The first lines of every other document held against those of the rest."""
    opening = table(spark, d, "documents").where("text IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", F.substring_index("text", "\n", 1).alias("line"))
    claims = opening.where("doc_id % 2 = 0").select(F.col("doc_id").alias("claim_id"), F.col("line").alias("claim"))
    known = opening.where("doc_id % 2 = 1").select(F.col("doc_id").alias("known_id"), F.col("line").alias("known"))
    return C.best_evidence(claims, known).withColumn("similarity", F.round("similarity", 6))


_NAMES = r"'[A-Z][a-z]+(?:\s+[A-Z][a-z]+)+'"


@query(f"WITH r AS (SELECT conv_id, unnest(regexp_extract_all(text, {_NAMES})) AS name FROM conversations WHERE role = 'assistant'), s AS (SELECT lower(unnest(regexp_extract_all(text, {_NAMES}))) AS name FROM documents) SELECT conv_id, name FROM r WHERE lower(name) NOT IN (SELECT name FROM s)")
def unknown_names(spark: SparkSession, d: str) -> DataFrame:
    return C.unknown_names(table(spark, d, "conversations").where("role = 'assistant'"), table(spark, d, "documents"), "conv_id", "text")


_CITED = "cited AS (SELECT o_orderkey, 'as shown [page ' || (o_orderkey % 9) || ', section ' || o_orderstatus || '] and [' || (o_custkey % 50) || ']' AS text FROM orders)"


@query(f"WITH {_CITED} SELECT o_orderkey, CAST(p AS INTEGER) AS page FROM (SELECT o_orderkey, unnest(regexp_extract_all(text, '\\[(?:page )?([0-9]+)', 1)) AS p FROM cited)")
def parsed_citations(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat(F.lit("as shown [page "), (F.col("o_orderkey") % 9).cast("string"), F.lit(", section "), F.col("o_orderstatus"), F.lit("] and ["), (F.col("o_custkey") % 50).cast("string"), F.lit("]"))
    return table(spark, d, "orders").select("o_orderkey", F.explode(F.regexp_extract_all(text, F.lit(r"(?i)\[(?:page\s+)?(\d+)(?:,\s*(?:section\s+)?[a-zA-Z0-9\s_.-]+)?\]"), F.lit(1))).alias("page")).select("o_orderkey", F.col("page").cast("int"))


@query("SELECT conv_id, turn, list_sort(list_distinct([CAST(turn AS INTEGER), CAST(turn + 2 AS INTEGER), CAST(conv_id % 9 AS INTEGER), 12])) AS pages FROM conversations WHERE text IS NOT NULL AND role = 'user'")
def asked_pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages that the users' turns name, a request for some of them being added to each."""
    turns = table(spark, d, "conversations").where("text IS NOT NULL AND role = 'user'")
    asked = F.concat("text", F.lit(" Compare pages "), F.col("turn").cast("string"), F.lit(", "), (F.col("turn") + 2).cast("string"), F.lit(" and "), (F.col("conv_id") % 9).cast("string"), F.lit(" with pg. 12"))
    return turns.select("conv_id", "turn", C.page_references(asked).alias("pages"))


@query("SELECT topic, count(*) AS n, bool_or(regexp_full_match(topic, 'order\\..*\\.urgent')) AS matches FROM (SELECT 'order.' || o_orderstatus || '.' || CASE WHEN o_orderpriority = '1-URGENT' THEN 'urgent' ELSE 'normal' END AS topic FROM orders) GROUP BY 1")
def topic_matches(spark: SparkSession, d: str) -> DataFrame:
    topic = F.concat(F.lit("order."), F.col("o_orderstatus"), F.lit("."), F.when(F.col("o_orderpriority") == "1-URGENT", "urgent").otherwise("normal"))
    return table(spark, d, "orders").groupBy(topic.alias("topic")).agg(F.count("*").alias("n")).withColumn("matches", C.glob(F.col("topic"), "order.*.urgent"))


@query("SELECT doc_id, count(*) AS numbers, CAST(min(len(CAST(CAST(v AS BIGINT) AS VARCHAR))) AS INTEGER) AS shortest, CAST(max(len(CAST(CAST(v AS BIGINT) AS VARCHAR))) AS INTEGER) AS longest FROM (SELECT doc_id, CAST(unnest(regexp_extract_all(text, '[0-9]{1,15}')) AS DOUBLE) AS v FROM documents) WHERE v > 0 GROUP BY 1 HAVING count(*) >= 3 AND max(len(CAST(CAST(v AS BIGINT) AS VARCHAR))) - min(len(CAST(CAST(v AS BIGINT) AS VARCHAR))) >= 4")
def number_inconsistencies(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit("([0-9]{1,15})"), F.lit(1))).alias("v")).select("doc_id", F.col("v").cast("bigint").alias("v")).where("v > 0")
    size = F.length(F.col("v").cast("string"))
    return v.groupBy("doc_id").agg(F.count("*").alias("numbers"), F.min(size).alias("shortest"), F.max(size).alias("longest")).where("numbers >= 3 AND longest - shortest >= 4")


_FAMILIES = {"money": r"[$€£¥₹]\s?[0-9,]+(?:\.[0-9]+)?", "percent": r"[0-9]+(?:\.[0-9]+)?\s?%", "email": r"[A-Za-z0-9_.-]+@[A-Za-z0-9_.-]+\.[A-Za-z0-9_]+", "url": r"https?://[^ \t\n\r\f\v]+", "date": r"[0-9]{4}-[0-9]{2}-[0-9]{2}", "phone": r"\+?[0-9]{1,3}[-. ]?\(?[0-9]{3}\)?[-. ]?[0-9]{3,4}[-. ]?[0-9]{4}"}
_ENTITIES = " UNION ALL ".join(f"SELECT doc_id, '{k}' AS type, lower(unnest(regexp_extract_all(text, '{p}'))) AS entity FROM documents" for k, p in _FAMILIES.items())


@query(f"SELECT doc_id, type, entity, count(*) AS mentions FROM ({_ENTITIES}) GROUP BY 1, 2, 3")
def text_entities(spark: SparkSession, d: str) -> DataFrame:
    return C.entities(table(spark, d, "documents"), "doc_id", "text", _FAMILIES).groupBy("doc_id", "type", "entity").agg(F.count("*").alias("mentions"))


@query("SELECT event_id, CAST(user_id % 4 AS INTEGER) AS page, event_type FROM events WHERE user_id % 7 = 3 AND event_type IN ('click', 'view') AND contains(props, '9') ORDER BY page, ts, event_id LIMIT 100")
def listed_annotations(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").where((F.col("user_id") % 7 == 3) & F.col("event_type").isin("click", "view") & F.contains("props", F.lit("9")))
    return e.withColumn("page", (F.col("user_id") % 4).cast("int")).orderBy("page", "ts", "event_id").select("event_id", "page", "event_type").limit(100)


@query("SELECT c_custkey, round(least(1, CASE WHEN c_custkey = 7 THEN 1 ELSE greatest(0, c_acctbal / 10000) * 0.5 + CASE WHEN contains(lower(c_name), '00') THEN 0.3 ELSE 0 END + CASE WHEN c_mktsegment = 'BUILDING' THEN 0.2 ELSE 0 END END), 8) AS score FROM customer ORDER BY score DESC, c_custkey LIMIT 15")
def recalled_items(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    score = F.greatest(F.lit(0.0), F.col("c_acctbal") / 10000) * 0.5 + F.when(F.contains(F.lower("c_name"), F.lit("00")), 0.3).otherwise(0.0) + F.when(F.col("c_mktsegment") == "BUILDING", 0.2).otherwise(0.0)
    return c.select("c_custkey", F.round(F.least(F.lit(1.0), F.when(F.col("c_custkey") == 7, 1.0).otherwise(score)), 8).alias("score")).orderBy(F.desc("score"), "c_custkey").limit(15)
