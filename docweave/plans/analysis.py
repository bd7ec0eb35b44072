"""Chunks, sentence ranks, hyperedges, signed ranks, singular values, caches, chains, loops."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.functions import text as T
from docweave.operators import analysis as A
from docweave.operators.graphs import components
from docweave.plans import behavior
from docweave.plans.base import ORACLE_SQL, query
from docweave.sources.relations import ELEMENTS_SQL, elements, table


_CHUNKS = f"""WITH RECURSIVE {ELEMENTS_SQL}, e AS (SELECT doc_id, seq, type = 'table' AS alone, CAST(ceil(length(content) / 4.0) AS BIGINT) AS n FROM elements),
c AS (SELECT doc_id, seq, alone, n AS held, CAST(0 AS INTEGER) AS chunk, n FROM e WHERE seq = 0
  UNION ALL SELECT e.doc_id, e.seq, e.alone, CASE WHEN c.alone OR e.alone OR c.held + e.n > 400 THEN e.n ELSE c.held + e.n END, c.chunk + CASE WHEN c.alone OR e.alone OR c.held + e.n > 400 THEN 1 ELSE 0 END, e.n FROM c JOIN e ON e.doc_id = c.doc_id AND e.seq = c.seq + 1)"""


@query(f'{_CHUNKS} SELECT doc_id, chunk, min(seq) AS "first", max(seq) AS "last", CAST(sum(n) AS BIGINT) AS tokens FROM c GROUP BY 1, 2')
def element_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of 400 tokens; tables stand alone."""
    e = elements(spark, d).withColumn("tokens", T.tokens_by_chars(F.col("content")).cast("long"))
    return A.chunks(e, "doc_id", 400, ["table"])


@query()
def sentence_ranks(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "documents").select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("i", "s"))
    return A.text_rank(s.select("doc_id", "i", T.words(F.col("s")).alias("words")), "doc_id")


@query("SELECT a.l_suppkey AS a, b.l_suppkey AS b, count(*) AS shared FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) a JOIN (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) b ON a.l_partkey = b.l_partkey AND a.l_suppkey < b.l_suppkey GROUP BY 1, 2")
def supplier_co_members(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers of one part are the members of its hyperedge."""
    return A.co_members(table(spark, d, "lineitem").select("l_partkey", "l_suppkey").distinct(), "l_partkey", "l_suppkey")


@query("WITH d AS (SELECT l_discount - l_tax AS d FROM lineitem WHERE l_discount <> l_tax), r AS (SELECT d, rank() OVER (ORDER BY abs(d)) + (count(*) OVER (PARTITION BY abs(d)) - 1) / 2 AS r FROM d), s AS (SELECT count(*) AS n, sum(CASE WHEN d > 0 THEN r ELSE 0 END) AS p, sum(CASE WHEN d < 0 THEN r ELSE 0 END) AS m FROM r) SELECT n, round(p, 1) AS w_plus, round(m, 1) AS w_minus, round((p - CAST(n AS DOUBLE) * (n + 1) / 4) / sqrt(CAST(n AS DOUBLE) * (n + 1) * (2 * n + 1) / 24), 6) AS z FROM s")
def wilcoxon_discount_tax(spark: SparkSession, d: str) -> DataFrame:
    s = A.signed_ranks(table(spark, d, "lineitem"), "l_discount", "l_tax")
    return s.select("n", F.round("w_plus", 1).alias("w_plus"), F.round("w_minus", 1).alias("w_minus"), F.round("z", 6).alias("z"))


@query()
def experiment_p_values(spark: SparkSession, d: str) -> DataFrame:
    """The experiment's t with a two-sided normal p."""
    return behavior.ab_test(spark, d).withColumn("p", A.two_sided_p("t"))


@query("WITH e AS (SELECT vec_id, unnest(CAST(embedding AS DOUBLE[])) AS x, unnest(range(0, len(embedding))) AS i FROM embeddings) SELECT CAST(a.i AS INTEGER) AS i, CAST(b.i AS INTEGER) AS j, round(sum(a.x * b.x), 6) AS value FROM e a JOIN e b ON a.vec_id = b.vec_id AND a.i <= b.i GROUP BY 1, 2")
def gram_matrix(spark: SparkSession, d: str) -> DataFrame:
    return A.gram(table(spark, d, "embeddings"), "embedding").withColumn("value", F.round("value", 6))


@query()
def singular_values(spark: SparkSession, d: str) -> DataFrame:
    return A.singular_values(table(spark, d, "embeddings"), "embedding", 10)


_LRU = """WITH RECURSIVE e AS (SELECT user_id, event_type AS x, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
c AS (SELECT user_id, i, [x] AS held, 0 AS hit FROM e WHERE i = 1 UNION ALL SELECT e.user_id, e.i, list_prepend(x, list_filter(held, lambda h: h <> x))[1:2], CASE WHEN list_contains(held, x) THEN 1 ELSE 0 END FROM c JOIN e ON e.user_id = c.user_id AND e.i = c.i + 1)"""


@query(f"{_LRU} SELECT user_id, count(*) AS accesses, CAST(sum(hit) AS BIGINT) AS hits FROM c GROUP BY 1")
def cache_hit_rates(spark: SparkSession, d: str) -> DataFrame:
    return A.cache_trace(table(spark, d, "events").select("user_id", "ts", "event_id", F.col("event_type").alias("item")), "user_id", ["ts", "event_id"], "item", 2)


_ROUNDS = "".join(f", s{i} AS (SELECT b AS state, sum(share * p) AS share FROM s{i - 1} JOIN m ON a = state GROUP BY 1)" for i in range(1, 26))


@query(f"WITH t AS ({ORACLE_SQL['markov_transitions']}), m AS (SELECT a, b, p / sum(p) OVER (PARTITION BY a) AS p FROM t), s0 AS (SELECT a AS state, 1 / CAST(count(*) OVER () AS DOUBLE) AS share FROM (SELECT DISTINCT a FROM m)){_ROUNDS} SELECT state, round(share / sum(share) OVER (), 6) AS share FROM s25")
def stationary_events(spark: SparkSession, d: str) -> DataFrame:
    return A.stationary(behavior.markov_transitions(spark, d), "a", "b", "p").withColumn("share", F.round("share", 6))


_LOOPS = f"""WITH RECURSIVE {ELEMENTS_SQL}, n AS (SELECT a.doc_id, a.page, a.seq AS a, b.seq AS b FROM elements a JOIN elements b ON a.doc_id = b.doc_id AND a.page = b.page AND a.seq <> b.seq WHERE sqrt(pow(a.x0 - b.x0, 2) + pow(a.y0 - b.y0, 2)) <= 0.25),
reach AS (SELECT doc_id, page, seq, seq AS other FROM elements UNION SELECT r.doc_id, r.page, r.seq, n.b FROM reach r JOIN n ON n.doc_id = r.doc_id AND n.page = r.page AND n.a = r.other),
least AS (SELECT doc_id, page, seq, min(other) AS part FROM reach GROUP BY 1, 2, 3), v AS (SELECT doc_id, page, count(*) AS vertices, count(DISTINCT part) AS parts FROM least GROUP BY 1, 2), e AS (SELECT doc_id, page, count(*) // 2 AS edges FROM n GROUP BY 1, 2)"""


@query(f"{_LOOPS} SELECT doc_id, page, vertices, coalesce(edges, 0) AS edges, parts, coalesce(edges, 0) - vertices + parts AS loops FROM v LEFT JOIN e USING (doc_id, page)")
def page_loops(spark: SparkSession, d: str) -> DataFrame:
    """Parts and loops of each page's elements whose corners lie within 0.25 of one another."""
    p = elements(spark, d).select("doc_id", "page", "seq", F.col("x0").alias("x"), F.col("y0").alias("y"))
    near = F.sqrt(F.pow(F.col("a_x") - F.col("b_x"), 2) + F.pow(F.col("a_y") - F.col("b_y"), 2)) <= 0.25
    return A.betti(p, ["doc_id", "page"], "seq", near)


_DOT = "list_dot_product(CAST({} AS DOUBLE[]), CAST({} AS DOUBLE[]))"


@query(f"""WITH RECURSIVE v AS (SELECT vec_id, embedding AS e, sqrt({_DOT.format('embedding', 'embedding')}) AS n FROM embeddings), near AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND a.n * b.n > 0 AND {_DOT.format('a.e', 'b.e')} / (a.n * b.n) >= 0.3),
reach AS (SELECT vec_id AS node, vec_id AS other FROM v UNION SELECT r.node, near.b FROM reach r JOIN near ON near.a = r.other) SELECT node, min(other) AS component FROM reach GROUP BY 1""")
def embedding_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Components of vectors with cosine 0.3 or more, whatever their labels, single ones included."""
    v = table(spark, d, "embeddings").select("vec_id", "embedding")
    loops = v.select(F.col("vec_id").alias("src"), F.col("vec_id").alias("dst"))
    return components(A.cosine_links(v, "vec_id", "embedding", 0.3).unionByName(loops))
