"""Text statistics over documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.functions import text as T
from docweave.operators import text_stats as S
from docweave.operators.graphs import written
from docweave.plans.base import query
from docweave.sources.relations import ELEMENTS_SQL, elements, table

TOKENS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')"
POST = rf"post AS (SELECT doc_id, source, lang, term, count(*) AS tf FROM (SELECT doc_id, source, lang, unnest({TOKENS}) AS term FROM documents) GROUP BY ALL)"


def docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


@query(f"WITH {POST}, n AS (SELECT count(*) AS n FROM documents) SELECT term, CAST(sum(tf) AS BIGINT) AS tf, count(*) AS df, round(ln((1 + any_value(n)) / (1 + count(*))) + 1, 9) AS idf, round(1 / (1 + ln(1 + sum(tf))), 9) AS inverse_weight, round(sum(tf) * (ln((1 + any_value(n)) / (1 + count(*))) + 1), 6) AS tfidf FROM post, n GROUP BY term")
def term_frequencies(spark: SparkSession, d: str) -> DataFrame:
    n = F.lit(docs(spark, d).count())
    f = S.frequencies(S.postings(docs(spark, d), "text", ["doc_id"]))
    idf = S.smooth_idf(n, F.col("df"))
    return f.select("term", "tf", "df", F.round(idf, 9).alias("idf"), F.round(1 / (1 + F.log(1 + F.col("tf"))), 9).alias("inverse_weight"), F.round(F.col("tf") * idf, 6).alias("tfidf"))


@query(f"WITH {POST}, t AS (SELECT lang, term, sum(tf) AS tf, count(*) AS df FROM post GROUP BY 1, 2), n AS (SELECT lang, count(*) AS n FROM documents GROUP BY 1), s AS (SELECT lang, term, round(tf * ln(n / df), 6) AS score FROM t JOIN n USING (lang)), r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, term) AS rank FROM s) SELECT lang, term, score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 20")
def tfidf_top_terms_by_lang(spark: SparkSession, d: str) -> DataFrame:
    n = docs(spark, d).groupBy("lang").agg(F.count("*").alias("n"))
    t = S.postings(docs(spark, d), "text", ["lang", "doc_id"]).groupBy("lang", "term").agg(F.sum("tf").alias("tf"), F.count("*").alias("df"))
    scored = t.join(F.broadcast(n), "lang").select("lang", "term", F.round(F.col("tf") * S.plain_idf(F.col("n"), F.col("df")), 6).alias("score"))
    return S.top_within(scored, ["lang"], 20, [F.desc("score"), F.asc("term")])


@query(f"WITH {POST}, t AS (SELECT source, term, sum(tf) AS tf FROM post GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY tf DESC, term) AS rank FROM t) SELECT source, term, CAST(tf AS BIGINT) AS tf, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 10")
def section_terms(spark: SparkSession, d: str) -> DataFrame:
    return S.top_within(S.postings(docs(spark, d), "text", ["source"]), ["source"], 10, [F.desc("tf"), F.asc("term")])


def _entropy_sql(by: str) -> str:
    keys = f"{by}," if by else ""
    t = f"SELECT {keys} term, sum(tf) AS tf FROM post GROUP BY ALL"
    g = f"SELECT {keys} CAST(sum(tf) AS BIGINT) AS tokens, count(*) AS types, log2(sum(tf)) - sum(tf * log2(tf)) / sum(tf) AS h, log2(count(*)) AS m FROM ({t}) {'GROUP BY ' + by if by else ''}"
    return f"WITH {POST} SELECT {keys} tokens, types, round(greatest(h, 0), 6) AS entropy, round(m, 6) AS max_entropy, round(CASE WHEN m > 0 THEN greatest(h, 0) / m ELSE 0 END, 6) AS normalized FROM ({g})"


def _entropy(spark: SparkSession, d: str, by: list[str]) -> DataFrame:
    e = S.entropy_by(S.postings(docs(spark, d), "text", by), by)
    return e.select(*by, "tokens", "types", *(F.round(c, 6).alias(c) for c in ("entropy", "max_entropy", "normalized")))


@query(_entropy_sql("doc_id"))
def doc_entropy_profile(spark: SparkSession, d: str) -> DataFrame:
    return _entropy(spark, d, ["doc_id"])


@query(_entropy_sql("source"))
def section_entropy(spark: SparkSession, d: str) -> DataFrame:
    return _entropy(spark, d, ["source"])


@query(_entropy_sql(""))
def corpus_entropy(spark: SparkSession, d: str) -> DataFrame:
    return _entropy(spark, d, [])


@query(f"WITH {POST}, e AS (SELECT doc_id, greatest(log2(sum(tf)) - sum(tf * log2(tf)) / sum(tf), 0) AS h FROM post GROUP BY 1), a AS (SELECT coalesce(h, 0) AS h FROM documents LEFT JOIN e USING (doc_id)) SELECT round(avg(h), 6) AS mean, round(max(h), 6) AS max, round(min(h), 6) AS min, round(stddev_pop(h), 6) AS std, round(median(h), 6) AS median, count(*) FILTER (h >= 1.5) AS informative FROM a")
def entropy_statistics(spark: SparkSession, d: str) -> DataFrame:
    """Texts without a word count with entropy 0."""
    e = S.entropy_by(S.postings(docs(spark, d), "text", ["doc_id"]), ["doc_id"]).select("doc_id", "entropy")
    h = F.coalesce("entropy", F.lit(0.0))
    a = docs(spark, d).select("doc_id").join(e, "doc_id", "left").select(h.alias("h"))
    return a.agg(F.round(F.avg("h"), 6).alias("mean"), F.round(F.max("h"), 6).alias("max"), F.round(F.min("h"), 6).alias("min"), F.round(F.stddev_pop("h"), 6).alias("std"), F.round(F.median("h"), 6).alias("median"), F.count_if(F.col("h") >= 1.5).alias("informative"))


@query("WITH c AS (SELECT doc_id, c, count(*) AS n FROM (SELECT doc_id, unnest(string_split(text, '')) AS c FROM documents) GROUP BY 1, 2) SELECT doc_id, CAST(sum(n) AS BIGINT) AS chars, round(greatest(log2(sum(n)) - sum(n * log2(n)) / sum(n), 0), 6) AS char_entropy FROM c GROUP BY 1")
def char_entropy(spark: SparkSession, d: str) -> DataFrame:
    c = docs(spark, d).select("doc_id", F.explode(F.split("text", "")).alias("term")).groupBy("doc_id", "term").agg(F.count("*").alias("tf"))
    return S.entropy_by(c, ["doc_id"]).select("doc_id", F.col("tokens").alias("chars"), F.round("entropy", 6).alias("char_entropy"))


@query(f"WITH {POST}, t AS (SELECT lang, term, sum(tf) AS tf FROM post GROUP BY 1, 2), n AS (SELECT lang, sum(tf) AS n FROM t GROUP BY 1), p AS (SELECT lang, term, tf / n AS p FROM t JOIN n USING (lang)), j AS (SELECT l.lang AS a, m.lang AS b, term, coalesce(x.p, 0) AS p, coalesce(y.p, 0) AS q FROM (SELECT DISTINCT term FROM p) t, n l, n m LEFT JOIN p x USING (term) LEFT JOIN p y USING (term) WHERE false), pairs AS (SELECT l.lang AS a, m.lang AS b FROM n l, n m WHERE l.lang < m.lang), u AS (SELECT a, b, term, max(CASE WHEN lang = a THEN p ELSE 0 END) AS p, max(CASE WHEN lang = b THEN p ELSE 0 END) AS q FROM pairs JOIN p ON lang = a OR lang = b GROUP BY 1, 2, 3) SELECT a, b, round(sum(CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2, 6) AS js_divergence FROM u GROUP BY 1, 2".replace("j AS (SELECT l.lang AS a, m.lang AS b, term, coalesce(x.p, 0) AS p, coalesce(y.p, 0) AS q FROM (SELECT DISTINCT term FROM p) t, n l, n m LEFT JOIN p x USING (term) LEFT JOIN p y USING (term) WHERE false), ", ""))
def language_divergence(spark: SparkSession, d: str) -> DataFrame:
    """Jensen-Shannon divergence of each two languages' word distributions."""
    t = S.postings(docs(spark, d), "text", ["lang"])
    p = t.join(F.broadcast(t.groupBy("lang").agg(F.sum("tf").alias("n"))), "lang").select("lang", "term", (F.col("tf") / F.col("n")).alias("p"))
    langs = docs(spark, d).select("lang").distinct()
    pairs = langs.select(F.col("lang").alias("a")).join(langs.select(F.col("lang").alias("b")), F.col("a") < F.col("b"))
    u = p.join(F.broadcast(pairs), (F.col("lang") == F.col("a")) | (F.col("lang") == F.col("b"))).groupBy("a", "b", "term").agg(F.max(F.when(F.col("lang") == F.col("a"), F.col("p")).otherwise(0.0)).alias("p"), F.max(F.when(F.col("lang") == F.col("b"), F.col("p")).otherwise(0.0)).alias("q"))
    m = (F.col("p") + F.col("q")) / 2
    part = lambda x: F.when(F.col(x) > 0, F.col(x) * F.log2(F.col(x) / m)).otherwise(0.0)
    return u.groupBy("a", "b").agg(F.round(F.sum(part("p") + part("q")) / 2, 6).alias("js_divergence"))


_SPANS = "SELECT unnest(regexp_extract_all(text, '[A-Z][a-z]+(?: [A-Z][a-z]+)*')) AS entity FROM documents"


@query(f"SELECT entity, count(*) AS n FROM ({_SPANS}) GROUP BY 1 ORDER BY n DESC, entity LIMIT 50")
def top_entities(spark: SparkSession, d: str) -> DataFrame:
    return S.capitalised_spans(docs(spark, d), "text").orderBy(F.desc("n"), "entity").limit(50)


@query(f"SELECT entity FROM ({_SPANS}) GROUP BY 1 HAVING count(*) = 1")
def rare_entities(spark: SparkSession, d: str) -> DataFrame:
    return S.capitalised_spans(docs(spark, d), "text").where("n = 1").select("entity")


_BLANK = "list_filter(string_split(trim(regexp_replace(text, '[ \\t\\n\\x0b\\f\\r]+', ' ', 'g')), ' '), lambda w: w <> '')"


@query(f"SELECT doc_id, CAST(greatest(1, floor(len(w) / CAST(0.75 AS DOUBLE))) AS INTEGER) AS by_words, CAST(greatest(1, floor(len(w) * CAST(1.33 AS DOUBLE))) AS INTEGER) AS of_block, CAST(ceil(length(text) / 4.0) AS INTEGER) AS by_chars FROM (SELECT doc_id, text, {_BLANK} AS w FROM documents)")
def token_counts(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return docs(spark, d).select("doc_id", T.tokens_by_words(t).alias("by_words"), T.tokens_of_block(t).alias("of_block"), T.tokens_by_chars(t).alias("by_chars"))


@query(f"SELECT doc_id, array_to_string(list_filter(w, lambda x, i: i = 1 OR x <> w[i - 1]), ' ') AS compressed FROM (SELECT doc_id, {_BLANK} AS w FROM documents)")
def compressed_texts(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select("doc_id", T.compressed(F.col("text")).alias("compressed"))


@query("SELECT doc_id, CASE WHEN length(text) <= 200 THEN text ELSE regexp_replace(substr(text, 1, 200), ' [^ ]*$', '') || '...' END AS cut, trim(regexp_replace(regexp_replace(text, '[ \\t]+', ' ', 'g'), '\\n{3,}', chr(10) || chr(10), 'g')) AS clean, substr(text, 1, 400) AS hundred_tokens FROM documents")
def truncated_texts(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return docs(spark, d).select("doc_id", T.truncated(t, 200).alias("cut"), T.cleaned(t).alias("clean"), F.substring(t, 1, 400).alias("hundred_tokens"))


_HASH = "sha256(lower(trim(regexp_replace(text, '[ \\t\\n\\x0b\\f\\r]+', ' ', 'g'))))"


@query(f"SELECT {_HASH} AS hash, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY 1 HAVING count(*) > 1")
def exact_dedup_groups(spark: SparkSession, d: str) -> DataFrame:
    return S.exact_groups(docs(spark, d), "doc_id", "text")


@query(f"SELECT min(doc_id) AS doc_id, {_HASH} AS hash FROM documents GROUP BY 2")
def deduplicated(spark: SparkSession, d: str) -> DataFrame:
    return S.first_of_equal(docs(spark, d), "doc_id", "text")


_POS, _NEG = ("[" + ", ".join(f"'{w}'" for w in ws) + "]" for ws in (T.POSITIVE, T.NEGATIVE))


@query(f"SELECT doc_id, round(CASE WHEN p + n > 0 THEN p / (p + n) ELSE 0 END, 6) AS positive, round(CASE WHEN p + n > 0 THEN n / (p + n) ELSE 0 END, 6) AS negative, round(CASE WHEN p + n > 0 THEN (p - n) / (p + n) ELSE 0 END, 6) AS compound FROM (SELECT doc_id, len(list_filter(w, lambda x: list_contains({_POS}, x))) AS p, len(list_filter(w, lambda x: list_contains({_NEG}, x))) AS n FROM (SELECT doc_id, {TOKENS} AS w FROM documents))")
def sentiment(spark: SparkSession, d: str) -> DataFrame:
    s = docs(spark, d).select("doc_id", S.sentiment(F.col("text")).alias("s"))
    return s.select("doc_id", *(F.round(f"s.{c}", 6).alias(c) for c in ("positive", "negative", "compound")))


_STOP = "[" + ", ".join(f"'{w}'" for w in T.STOP_WORDS) + "]"


@query(rf"""WITH t AS (SELECT doc_id, list_filter({TOKENS}, lambda x: NOT list_contains({_STOP}, x)) AS w FROM documents),
uni AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM t) GROUP BY 1, 2),
idf AS (SELECT term, ln((1 + (SELECT count(*) FROM documents)) / (1 + count(*))) + 1 AS idf FROM uni GROUP BY 1),
pairs AS (SELECT doc_id, a, b, count(*) AS n FROM (SELECT doc_id, w[i] AS a, w[i + 1] AS b FROM (SELECT doc_id, w, unnest(range(1, len(w))) AS i FROM t)) GROUP BY ALL),
s AS (SELECT doc_id, term AS phrase, tf * idf AS score FROM uni JOIN idf USING (term) UNION ALL SELECT p.doc_id, a || ' ' || b, x.tf * y.tf * 1.5 FROM pairs p JOIN uni x ON x.doc_id = p.doc_id AND x.term = a JOIN uni y ON y.doc_id = p.doc_id AND y.term = b),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 9) DESC, phrase) AS rank FROM s)
SELECT doc_id, phrase, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 5""")
def keyphrases(spark: SparkSession, d: str) -> DataFrame:
    return S.keyphrases(docs(spark, d), "text", "doc_id", 5).withColumn("score", F.round("score", 6))


def summaries(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select("doc_id", T.digest_summary(F.col("text")).alias("summary"), F.size(T.sentences(F.col("text"))).alias("n_sentences"))


_SENT = r"list_filter(list_transform(string_split_regex(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: trim(s)), lambda s: s <> '')"
query(rf"SELECT doc_id, array_to_string(CASE WHEN len(s) > 4 THEN [s[1], s[2], s[len(s) // 2 + 1], s[len(s)]] ELSE s END, ' ') AS summary, CAST(len(s) AS INTEGER) AS n_sentences FROM (SELECT doc_id, {_SENT} AS s FROM documents)")(summaries)


@query(rf"""WITH {POST}, n AS (SELECT source, count(*) AS docs FROM documents GROUP BY 1), t AS (SELECT source, sum(tf) AS tokens, count(DISTINCT term) AS types FROM post GROUP BY 1) SELECT source, docs, CAST(tokens AS BIGINT) AS tokens, types, round(tokens / docs, 6) AS mean_tokens, round(types / tokens, 6) AS type_ratio FROM n JOIN t USING (source)""")
def section_statistics(spark: SparkSession, d: str) -> DataFrame:
    n = docs(spark, d).groupBy("source").agg(F.count("*").alias("docs"))
    t = S.postings(docs(spark, d), "text", ["source"]).groupBy("source").agg(F.sum("tf").alias("tokens"), F.count("*").alias("types"))
    return n.join(t, "source").select("source", "docs", "tokens", "types", F.round(F.col("tokens") / F.col("docs"), 6).alias("mean_tokens"), F.round(F.col("types") / F.col("tokens"), 6).alias("type_ratio"))


_SETS = r"""w AS (SELECT doc_id, list_sort(list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'))) AS w FROM documents), f AS (SELECT w, min(doc_id) AS id FROM w WHERE len(w) > 0 GROUP BY 1), k AS (SELECT id, len(w) AS n, unnest(w) AS term FROM f),
met AS (SELECT a.id AS a, b.id AS b, any_value(a.n) AS x, any_value(b.n) AS y, count(*) AS m FROM k a JOIN k b USING (term) WHERE a.id < b.id GROUP BY 1, 2)"""


@query(f"WITH {_SETS} SELECT a, b, round(m / (x + y - m), 6) AS jaccard FROM met WHERE m / (x + y - m) >= 0.5 UNION ALL SELECT f.id, doc_id, 1 FROM w JOIN f USING (w) WHERE doc_id <> f.id")
def jaccard_pairs(spark: SparkSession, d: str) -> DataFrame:
    """All pairs of different word sets with Jaccard similarity 0.5 or more, and the ids of equal sets."""
    return S.similar_sets(docs(spark, d), "doc_id", T.words(F.col("text")), 0.5).withColumn("jaccard", F.round("jaccard", 6))


@query()
def minhash_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Candidates of 32 MinHash bands of 4 with their estimated similarity; banding has no SQL counterpart of equal hashes.

    Pairs are between the smallest ids of distinct signatures; each other id of a signature is paired with its smallest
    (``member``, similarity 1), so all pairs of ids can be had from these.
    """
    s = written(S.min_signatures(docs(spark, d), "doc_id", T.words(F.col("text")), 128), "signatures")
    classes = written(S.signature_classes(s, "doc_id"), "classes")
    pairs = S.band_pairs(classes.select("doc_id", "signature"), "doc_id", 32, 4).withColumn("member", F.lit(False))
    first = classes.where("n > 1").select(F.col("doc_id").alias("a"), F.col("signature").alias("x"))
    members = s.join(first, s.signature == first.x).where("doc_id != a").select("a", F.col("doc_id").alias("b"), F.lit(1.0).alias("similarity"), F.lit(True).alias("member"))
    return pairs.unionByName(members)


@query(f"WITH {ELEMENTS_SQL} SELECT doc_id, seq, content, substr(sha256(lower(trim(regexp_replace(content, '[ \\t\\n\\x0b\\f\\r]+', ' ', 'g')))), 1, 16) AS content_hash, '[' || section || ' | Page ' || page || '] ' || content AS prefixed, CASE WHEN len(string_split(content, ' ')) > 10 THEN array_to_string((string_split(content, ' '))[1:len(string_split(content, ' ')) // 2], ' ') ELSE content END AS coarse FROM elements")
def element_texts(spark: SparkSession, d: str) -> DataFrame:
    """Content hash, contextual prefix and coarse grain of each element."""
    c, w = F.col("content"), F.split("content", " ")
    half = F.when(F.size(w) > 10, F.array_join(F.slice(w, 1, F.floor(F.size(w) / 2).cast("int")), " ")).otherwise(c)
    return elements(spark, d).select("doc_id", "seq", "content", T.normal_hash(c).alias("content_hash"), F.concat(F.lit("["), "section", F.lit(" | Page "), F.col("page").cast("string"), F.lit("] "), c).alias("prefixed"), half.alias("coarse"))
