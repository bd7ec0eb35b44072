"""One query for each operator, bound to the tables with production parameters, and the SQL that repeats it where there is one.

A query derives the digest columns of its contract from what its operator returns.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.llm import ann, decontam, html_extract, langid, line_dedup, packing, pii, quality, simhash, sort_means, substring_dedup, url_filter, whitening
from docweave.llm.common import bucket, table

#: Rules of the URL filter, and sites that its list blocks where no rule fits.
URL_RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]
LISTED_SITES = ["adult-x", "ads-track", "casino-win", "cheap-pills", "free-bets", "spam-farm"]
LISTED_PATHS = [("example.net", "/en/9"), ("example.com", "/es/7")]
LISTED_URLS = [f"http://{site}.example.{tld}/" for site in LISTED_SITES for tld in ("com", "net", "org")] + [f"https://{host}{path}" for host, path in LISTED_PATHS]
#: Key of the surrogates where the session's setting ``spark.docweave.surrogates.key`` names none.
PII_KEY = "docweave-surrogates"
QUALITY_THRESHOLD = 0.3
LANG_CHARS = 20_000
VOCABULARY = "byte_bpe_50k.json"


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = url_filter.entries(spark, URL_RULES, spark.createDataFrame([(u,) for u in LISTED_URLS], "url string"))
    return url_filter.filter_urls(table(spark, sf_dir, "pages"), listed)


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, distance=3)


def op3_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = html_extract.extract_main_text(table(spark, sf_dir, "pages"), ["page_id", "url"])
    return out.withColumn("n_chars", F.length("text").cast("long"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.dedup_substrings(table(spark, sf_dir, "documents"), window=13)
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def surrogate_key(spark: SparkSession) -> str:
    return spark.conf.get("spark.docweave.surrogates.key", PII_KEY)


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.replace_private(table(spark, sf_dir, "documents"), surrogate_key(spark)).select("doc_id", "text", "n_entities")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


def quality_model(docs: DataFrame, labels: DataFrame) -> quality.Model:
    return quality.Model(quality.training_rows(docs, labels, bucket(of=5) != 0, "quality"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = quality.score_quality(docs, quality_model(docs, table(spark, sf_dir, "labels")), keep=["doc_id"])
    return out.select("doc_id", (bucket(of=5) == 0).alias("held_out"), "score", (F.col("score") >= QUALITY_THRESHOLD).cast("int").alias("predicted"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10)
    items = F.array_join(F.array_sort("item_ids"), ",")
    return out.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(items.cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def language_model(docs: DataFrame) -> langid.Model:
    return langid.Model(langid.training_texts(docs, bucket(of=3) != 1, chars=LANG_CHARS), LANG_CHARS)


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = langid.identify(docs.select("doc_id", "text"), language_model(docs))
    return out.select("doc_id", (bucket(of=3) == 1).alias("held_out"), "lang_pred", "score")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = whitening.whiten(table(spark, sf_dir, "embeddings"), components=4, scale=256)
    return out.withColumn("deviation", F.col("deviation").try_cast("long"))


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), least=10)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op13_sort_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sort_means.cluster(table(spark, sf_dir, "embeddings"), centroids=16, rounds=3, dimensions=64, scale=64, seed=1)
    whole = (F.col(c).try_cast("long").alias(c) for c in ("distance", "cluster_inertia", "inertia"))
    text = F.array_join(F.transform("centroid", lambda v: v.cast("string")), ",")
    return out.select("vec_id", "cluster", *whole, F.sha2(text.cast("binary"), 256).alias("centroid_sha256"))


QUERIES = {f.__name__: f for f in (op1_url_filter, op2_simhash, op3_html_extract, op4_substring_dedup, op5_pii, op6_packing, op7_quality, op8_decontamination, op9_nearest, op10_language, op11_whitening, op12_line_dedup, op13_sort_means)}

_HOST = r"translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PATH = r"coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '')"
_RULES = ", ".join(f"('{v}', '{r.partition('/')[0]}', '/{r.partition('/')[2]}', '{r}')" for v, r in URL_RULES)
_LISTED = ", ".join(f"('{site}.example.{tld}', '/')" for site in LISTED_SITES for tld in ("com", "net", "org")) + "".join(f", ('{host}', '{path}')" for host, path in LISTED_PATHS)
#: The parts of a canonical address that the tables' urls need: no user, port or final dot; a path.
_CLEAN_HOST = r"regexp_replace(regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', ''), '\.+$', '')"
_CLEAN_PATH = "CASE WHEN path = '' THEN '/' ELSE path END"

_FLOOR_MEAN = "CAST((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT)"
_ROUNDS = "".join(
    f"""
a{i} AS MATERIALIZED (SELECT v.rid, arg_min(c.cluster, (c.dist, c.cluster)) AS cluster, min(c.dist) AS distance
  FROM v JOIN (SELECT e.rid, k.cluster, sum((e.x - k.x) * (e.x - k.x)) AS dist FROM e JOIN c{i} AS k USING (i) GROUP BY ALL) AS c USING (rid) GROUP BY v.rid),"""
    + (
        f"""
c{i + 1} AS MATERIALIZED (SELECT k.cluster, k.i, coalesce(m.x, k.x) AS x FROM c{i} AS k
  LEFT JOIN (SELECT cluster, i, {_FLOOR_MEAN} AS x FROM e JOIN a{i} USING (rid) GROUP BY cluster, i) AS m USING (cluster, i)),"""
        if i < 3
        else ""
    )
    for i in range(4)
)

ORACLE_SQL = {
    "op12_line_dedup": r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
line AS (SELECT rid, doc_id, unnest(l) AS line, unnest(range(1, len(l) + 1)) AS p FROM d),
keyed AS (SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM line),
least AS (SELECT k, min(doc_id) AS least FROM keyed WHERE length(k) >= 10 GROUP BY k),
judged AS (SELECT rid, p, line, coalesce(doc_id > least, false) AS gone FROM keyed LEFT JOIN least USING (k)),
done AS (SELECT rid, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, string_agg(line, chr(10) ORDER BY p) FILTER (NOT gone) AS kept FROM judged GROUP BY rid)
SELECT doc_id, n_lines, n_dropped, sha256(coalesce(kept, '')) AS kept_sha256 FROM d JOIN done USING (rid)""",
    "op13_sort_means": f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda c: CAST(floor(64 * CAST(c AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
e AS MATERIALIZED (SELECT rid, unnest(x) AS x, unnest(range(1, 65)) AS i FROM v),
first AS (SELECT x, row_number() OVER (ORDER BY sha256('1:' || coalesce(CAST(vec_id AS VARCHAR), 'null')), x) - 1 AS cluster FROM v QUALIFY cluster < 16),
c0 AS MATERIALIZED (SELECT cluster, unnest(x) AS x, unnest(range(1, 65)) AS i FROM first),{_ROUNDS}
named AS (SELECT cluster, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY i)) AS centroid_sha256 FROM c3 GROUP BY cluster),
sums AS (SELECT cluster, CAST(sum(distance) AS BIGINT) AS cluster_inertia FROM a3 GROUP BY cluster)
SELECT vec_id, CAST(cluster AS INTEGER) AS cluster, CAST(distance AS BIGINT) AS distance, cluster_inertia, CAST((SELECT sum(distance) FROM a3) AS BIGINT) AS inertia, centroid_sha256
FROM v JOIN a3 USING (rid) JOIN named USING (cluster) JOIN sums USING (cluster)""",
    "op1_url_filter": f"""
WITH p AS (SELECT row_number() OVER () AS rid, page_id, {_HOST} AS host, {_PATH} AS path FROM pages),
r(verdict, host, path, rule) AS (VALUES {_RULES}),
l(host, path) AS (VALUES {_LISTED}),
c AS (SELECT rid, {_CLEAN_HOST} AS host, {_CLEAN_PATH} AS path FROM p),
best AS (
  SELECT p.rid, max_by(r.rule, length(r.rule)) AS rule, max_by(r.verdict, length(r.rule)) AS verdict
  FROM p JOIN r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path) GROUP BY p.rid),
hit AS (SELECT DISTINCT c.rid FROM c JOIN l ON (c.host = l.host OR ends_with(c.host, '.' || l.host)) AND starts_with(c.path, l.path))
SELECT page_id, p.host, p.path, best.rule, coalesce(best.verdict, CASE WHEN hit.rid IS NOT NULL THEN 'block' END, 'allow') AS verdict, hit.rid IS NOT NULL AS listed
FROM p LEFT JOIN best USING (rid) LEFT JOIN hit USING (rid)""",
    "op8_decontamination": r"""
WITH it AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
win AS (SELECT DISTINCT item_id, array_to_string(w[i:i+9], ' ') AS k, least(len(w), 10) AS n FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM it WHERE len(w) > 0)),
d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
sizes AS (SELECT DISTINCT n FROM win),
dw AS (SELECT rid, i, n, array_to_string(w[i:i+n-1], ' ') AS k FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
hit AS (SELECT dw.rid, dw.i, dw.n, win.item_id FROM dw JOIN win ON dw.k = win.k AND dw.n = win.n),
pos AS (SELECT rid, count(DISTINCT x) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS x FROM hit) GROUP BY rid),
its AS (SELECT rid, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS s FROM hit GROUP BY rid)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (rid) LEFT JOIN its USING (rid)""",
    "op4_substring_dedup": r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
win AS (SELECT rid, doc_id, i, array_to_string(w[i:i+12], ' ') AS k FROM (SELECT rid, doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)),
firsts AS (SELECT k, min(doc_id) AS least FROM win GROUP BY k),
gone AS (SELECT rid, list_distinct(flatten(list(range(i, i + 13)))) AS places FROM win JOIN firsts USING (k) WHERE least < doc_id GROUP BY rid),
kept AS (SELECT d.rid, array_to_string(list(x ORDER BY p), ' ') AS s FROM (SELECT rid, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d) AS d LEFT JOIN (SELECT rid, unnest(places) AS p FROM gone) AS g USING (rid, p) WHERE g.rid IS NULL GROUP BY d.rid)
SELECT doc_id, len(w) AS n_words, coalesce(len(places), 0) AS n_removed, sha256(coalesce(s, '')) AS kept_sha256
FROM d LEFT JOIN gone USING (rid) LEFT JOIN kept USING (rid)""",
}
