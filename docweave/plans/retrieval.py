"""Searches over documents and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.functions import vectors as V
from docweave.operators import fusion, retrieval as R
from docweave.plans.base import query
from docweave.sources.relations import table

QUERY = "the of thing la der que the"
WORDS = ["der", "la", "of", "que", "the", "thing"]
_TOKENS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')"
_TIMES = "(VALUES ('der', 1), ('la', 1), ('of', 1), ('que', 1), ('the', 2), ('thing', 1)) AS q(term, times)"
_LEX = rf"""w AS (SELECT doc_id, {_TOKENS} AS w FROM documents), len AS (SELECT doc_id, len(w) AS dl FROM w), n AS (SELECT count(*) AS n, avg(dl) AS mean FROM len),
tf AS (SELECT doc_id, term, times, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM w) JOIN {_TIMES} USING (term) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
bm25 AS (SELECT doc_id AS item_id, sum(times * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / mean))) AS score FROM tf JOIN df USING (term) JOIN len USING (doc_id), n GROUP BY 1),
tfidf AS (SELECT doc_id AS item_id, sum(times * tf * ln(n / df)) AS score FROM tf JOIN df USING (term), n GROUP BY 1)"""
_Q = "q AS (SELECT embedding AS qv FROM embeddings ORDER BY vec_id LIMIT 1)"
_DOT = "list_dot_product(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[]))"
_AB = _DOT.format(a="embedding", b="qv")
_COS = f"CASE WHEN {_DOT.format(a='embedding', b='embedding')} * {_DOT.format(a='qv', b='qv')} > 0 THEN {_AB} / (sqrt({_DOT.format(a='embedding', b='embedding')}) * sqrt({_DOT.format(a='qv', b='qv')})) ELSE 0 END"
_L2 = "sqrt(list_sum(list_transform(list_zip(CAST(embedding AS DOUBLE[]), CAST(qv AS DOUBLE[])), lambda z: pow(z[1] - z[2], 2))))"
_L1 = "list_sum(list_transform(list_zip(CAST(embedding AS DOUBLE[]), CAST(qv AS DOUBLE[])), lambda z: abs(z[1] - z[2])))"
_LINF = _L1.replace("list_sum(", "list_max(", 1)


def _top(source: str, k: int = 20) -> str:
    return f"SELECT item_id, round(score, 6) AS score FROM {source} ORDER BY round(score, 9) DESC, item_id LIMIT {k}"


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings")


def plain(x: str, n):
    """Whether a vector has n components, none null, NaN or so large that a square is not finite."""
    return F.coalesce((F.size(x) == n) & F.forall(x, lambda y: y.isNotNull() & (F.abs(y) < 1e100)), F.lit(False))


def best(scored: DataFrame, k: int = 20) -> DataFrame:
    return R.top(scored, k).select("item_id", F.round("score", 6).alias("score"))


@query(f"WITH {_LEX} {_top('bm25')}")
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return best(R.lexical(table(spark, d, "documents"), QUERY))


@query(f"WITH {_LEX} {_top('tfidf')}")
def tfidf_topk(spark: SparkSession, d: str) -> DataFrame:
    return best(R.lexical(table(spark, d, "documents"), QUERY, kind="tfidf"))


def _dense(measure: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        v = vectors(spark, d)
        return best(R.dense(v, R.vector_of(v, "vec_id", "embedding"), measure))

    run.__name__ = f"{measure}_topk"
    return run


for _measure, _sql in (("cosine", _COS), ("dot", _AB), ("l2", f"-{_L2}"), ("l1", f"-{_L1}"), ("linf", f"-{_LINF}")):
    query(f"WITH {_Q}, s AS (SELECT vec_id AS item_id, {_sql} AS score FROM embeddings, q) {_top('s')}")(_dense(_measure))


@query(f"WITH {_Q}, s AS (SELECT vec_id AS item_id, {_L2} AS distance FROM embeddings, q) SELECT item_id, round(distance, 6) AS distance, round(1 / (1 + distance), 6) AS similarity FROM s WHERE distance <= 1.3")
def radius_search(spark: SparkSession, d: str) -> DataFrame:
    v = vectors(spark, d)
    near = R.radius(v, R.vector_of(v, "vec_id", "embedding"), 1.3)
    return near.select("item_id", F.round("distance", 6).alias("distance"), F.round(1 / (1 + F.col("distance")), 6).alias("similarity"))


@query("SELECT vec_id AS item_id FROM embeddings WHERE embedding[1] BETWEEN -0.1 AND 0.1 AND embedding[2] BETWEEN -0.1 AND 0.2")
def box_search(spark: SparkSession, d: str) -> DataFrame:
    return R.in_box(vectors(spark, d), [-0.1, -0.1], [0.1, 0.2])


@query("SELECT label, CAST(pos - 1 AS INTEGER) AS pos, round(avg(x), 6) AS mean FROM (SELECT label, unnest(CAST(embedding AS DOUBLE[])) AS x, unnest(range(1, len(embedding) + 1)) AS pos FROM embeddings) GROUP BY 1, 2")
def label_centroids(spark: SparkSession, d: str) -> DataFrame:
    v = vectors(spark, d).withColumn("embedding", F.col("embedding").cast("array<double>"))
    return R.centroids(v, "label").withColumn("mean", F.round("mean", 6))


@query(f"""WITH a AS (SELECT vec_id AS qid, embedding AS qv FROM embeddings WHERE vec_id % 20 = 0), s AS (SELECT qid, vec_id AS item_id, {_COS} AS score FROM a JOIN embeddings ON vec_id <> qid), r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, item_id) AS rank FROM s) SELECT qid, item_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 5""")
def similar_to_each(spark: SparkSession, d: str) -> DataFrame:
    """The five nearest others of each query row; queries are a stated set and are sent to the vectors once their size is checked."""
    from docweave.operators.text_stats import top_within

    v = vectors(spark, d)
    asked = v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qv"))
    seen = asked.agg(F.sum(F.size("qv")).alias("numbers"), F.min(F.size("qv")).alias("least"), F.bool_and(plain("qv", F.size("qv"))).alias("plain"), F.max(F.size("qv")).alias("most")).first()
    small = (seen.numbers or 0) <= 4 << 20  # numbers sent to every task: 32 MB
    rows = lambda x: x.join(F.broadcast(asked) if small else asked, F.col("vec_id") != F.col("qid")).select("qid", F.col("vec_id").alias("item_id"), V.cosine(F.col("embedding"), F.col("qv")).alias("score"))
    if small and seen.plain and seen.least == seen.most and seen.least > 0:
        usual = plain("embedding", seen.least) & F.col("vec_id").isNotNull()
        double = lambda x: F.col(x).cast("array<double>")
        s = R.near_cosines(v.where(usual).select(F.col("vec_id").alias("item_id"), double("embedding").alias("v")), asked.select("qid", double("qv").alias("qv")), 5).unionByName(rows(v.where(~usual)))
    else:
        s = rows(v)
    return top_within(s, ["qid"], 5, [F.desc(F.round("score", 9)), F.asc("item_id")]).withColumn("score", F.round("score", 6))


@query(f"""WITH {_Q}, {_LEX}, c AS (SELECT vec_id AS item_id, {_COS} AS score FROM embeddings, q),
l AS (SELECT *, row_number() OVER (ORDER BY round(score, 9) DESC, item_id) AS rank FROM bm25 QUALIFY rank <= 50), e AS (SELECT *, row_number() OVER (ORDER BY round(score, 9) DESC, item_id) AS rank FROM c QUALIFY rank <= 50),
u AS (SELECT item_id, 0.4 / (60 + rank) AS s, 'frequency' AS m FROM l UNION ALL SELECT item_id, 0.6 / (60 + rank), 'semantic' FROM e),
f AS (SELECT item_id, round(sum(s), 9) AS fused_score, string_agg(m, ',' ORDER BY m) AS methods_found FROM u GROUP BY 1)
SELECT item_id, fused_score, CAST(row_number() OVER (ORDER BY fused_score DESC, item_id) AS INTEGER) AS final_rank, methods_found FROM f ORDER BY fused_score DESC, item_id LIMIT 20""")
def hybrid_rrf_topk(spark: SparkSession, d: str) -> DataFrame:
    """BM25 and cosine lists of 50, fused by reciprocal rank."""
    from pyspark.sql import Window

    v = vectors(spark, d)
    legs = [("frequency", R.lexical(table(spark, d, "documents"), QUERY).select("item_id", "score")), ("semantic", R.dense(v, R.vector_of(v, "vec_id", "embedding")))]
    scores = None
    for name, leg in legs:
        part = R.top(leg, 50).select(F.lit(name).alias("method"), "item_id", F.round("score", 9).alias("score"))
        scores = part if scores is None else scores.unionByName(part)
    fused = fusion.reciprocal_rank(scores, fusion.normalised({"frequency": 0.2, "semantic": 0.3}, ["frequency", "semantic"], 1.0), bounded=True)
    out = fused.select("item_id", F.round("fused", 9).alias("fused_score"), F.array_join("methods", ",").alias("methods_found"))
    # at most 100 rows: two lists of 50
    return out.withColumn("final_rank", F.row_number().over(Window.orderBy(F.desc("fused_score"), "item_id"))).where("final_rank <= 20")


@query()
def marginal_relevance(spark: SparkSession, d: str) -> DataFrame:
    """Ten diverse picks of the 50 vectors nearest to the first; greedy, so held to brute force in tests."""
    v = vectors(spark, d)
    near = R.top(R.dense(v, R.vector_of(v, "vec_id", "embedding")), 50).join(v.select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("vector")), "item_id")
    return R.maximal_marginal(near, 10)


@query("""WITH c AS (SELECT vec_id, embedding AS cv FROM embeddings WHERE vec_id % 50 = 0), s AS (SELECT e.vec_id AS item_id, c.vec_id AS list, sqrt(list_sum(list_transform(list_zip(CAST(embedding AS DOUBLE[]), CAST(cv AS DOUBLE[])), lambda z: pow(z[1] - z[2], 2)))) AS dist FROM embeddings e, c), r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(dist, 9), list) AS rank FROM s) SELECT list, count(*) AS members, round(avg(dist), 6) AS mean_distance FROM r WHERE rank = 1 GROUP BY 1""")
def inverted_lists(spark: SparkSession, d: str) -> DataFrame:
    """Vectors assigned to the nearest of strided centroids: list sizes and mean distances."""
    v = vectors(spark, d)
    c = v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("list"), F.col("embedding").alias("cv"))
    # plain vectors, all of the lists' length, go as matrices; any others, row by row
    seen = c.agg(F.sum(F.size("cv")).alias("numbers"), F.min(F.size("cv")).alias("least"), F.bool_and(plain("cv", F.size("cv"))).alias("plain"), F.max(F.size("cv")).alias("most")).first()
    small = (seen.numbers or 0) <= 4 << 20
    rows = lambda x: x.join(F.broadcast(c) if small else c).select(F.col("vec_id").alias("item_id"), "list", V.l2(F.col("embedding"), F.col("cv")).alias("dist"))
    if small and seen.plain and seen.least == seen.most and seen.least > 0:
        usual = plain("embedding", seen.least) & F.col("vec_id").isNotNull()
        double = lambda x: F.col(x).cast("array<double>")
        s = R.near_lists(v.where(usual).select(F.col("vec_id").alias("item_id"), double("embedding").alias("v")), c.select("list", double("cv").alias("cv"))).unionByName(rows(v.where(~usual)))
    else:
        s = rows(v)
    near = s.groupBy("item_id").agg(F.min_by(F.struct("list", "dist"), F.struct(F.round("dist", 9), "list")).alias("best"))
    return near.groupBy(F.col("best.list").alias("list")).agg(F.count("*").alias("members"), F.round(F.avg("best.dist"), 6).alias("mean_distance"))
