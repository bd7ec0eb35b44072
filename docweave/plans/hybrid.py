"""One question over seven legs: words, vectors, page templates, table rows, values, recurrence and the graph, fused by rank."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docweave.operators import elements as E
from docweave.operators import fusion, matrix, paths
from docweave.operators import retrieval as R
from docweave.plans.base import query
from docweave.plans.elements import _HASH, _PAGES
from docweave.plans.retrieval import _COS, _LEX, _Q, QUERY, vectors
from docweave.sources.relations import elements, table

WEIGHTS = {"frequency": 0.2, "semantic": 0.3, "template": 0.1, "row": 0.1, "value": 0.1, "recurrence": 0.1, "graph": 0.1}
LONGEST = 50
_BLANKS = "(length(text) - length(replace(text, ' ', '')))"
_SQL_LEGS = {
    "frequency": "SELECT item_id, score FROM bm25",
    "semantic": f"SELECT vec_id AS item_id, {_COS} AS score FROM embeddings, q",
    "template": "SELECT p.doc_id AS item_id, round(list_dot_product(p.signature, s.signature), 7) AS score FROM page_signatures p, (SELECT signature FROM page_signatures WHERE doc_id = 1 AND page = 1) s WHERE p.page = 1 AND p.doc_id <> 1",
    "row": f"SELECT doc_id AS item_id, CASE WHEN n_chars > 0 THEN (n_chars * 2000.0 + {_BLANKS} * 300.0) / (sqrt(n_chars * CAST(n_chars AS DOUBLE) + {_BLANKS} * CAST({_BLANKS} AS DOUBLE)) * sqrt(CAST(4090000 AS DOUBLE))) ELSE 0 END AS score FROM documents",
    "value": "SELECT doc_id AS item_id, 1 / (1 + abs(n_chars - CAST(500 AS DOUBLE))) AS score FROM documents WHERE abs(n_chars - 500) <= 50",
    "recurrence": f"SELECT doc_id AS item_id, avg(CASE WHEN copies >= 3 THEN CAST(0.15 AS DOUBLE) WHEN copies = 2 THEN 0.4 ELSE 0.9 END) AS score FROM elements e LEFT JOIN rec ON rec.hash = {_HASH.replace('content', 'e.content')} AND trim(e.content) <> '' GROUP BY 1",
    "graph": "SELECT doc_id AS item_id, CASE WHEN doc_id = 1 THEN CAST(0.85 AS DOUBLE) ELSE 0 END + (0.85 * pow(CAST(0.15 AS DOUBLE), 2) + 0.85 * pow(CAST(0.15 AS DOUBLE), 4)) / n AS score FROM documents, (SELECT source AS of, count(*) AS n FROM documents GROUP BY 1) WHERE source = of AND source = (SELECT source FROM documents WHERE doc_id = 1)",
}
_LEGS = " UNION ALL ".join(f"SELECT '{m}' AS method, item_id, rank FROM (SELECT item_id, row_number() OVER (ORDER BY round(score, 9) DESC, item_id) AS rank FROM ({sql})) WHERE rank <= {LONGEST}" for m, sql in _SQL_LEGS.items())
_WEIGHTS = "w(method, w) AS (VALUES " + ", ".join(f"('{m}', CAST({w} AS DOUBLE))" for m, w in WEIGHTS.items()) + ")"
_REC = f"rec AS (SELECT {_HASH} AS hash, count(*) AS copies FROM elements WHERE trim(content) <> '' GROUP BY 1)"


@query(f"""{_PAGES}, {_Q}, {_LEX.replace('w AS (SELECT doc_id,', 'lw AS (SELECT doc_id,').replace('FROM w)', 'FROM lw)')}, {_REC}, {_WEIGHTS}, legs AS ({_LEGS}), f AS (SELECT item_id, round(sum(w / (60 + rank)), 9) AS fused_score, string_agg(method, ',' ORDER BY method) AS methods_found FROM legs JOIN w USING (method) GROUP BY 1)
SELECT item_id, fused_score, CAST(row_number() OVER (ORDER BY fused_score DESC, item_id) AS INTEGER) AS final_rank, methods_found FROM f ORDER BY fused_score DESC, item_id LIMIT 25""")
def seven_leg_search(spark: SparkSession, d: str) -> DataFrame:
    docs, v, e = table(spark, d, "documents"), vectors(spark, d), elements(spark, d)
    pages = E.page_signatures(e).where("page = 1")
    blanks = F.length("text") - F.length(F.replace("text", F.lit(" "), F.lit("")))
    from docweave.functions import text as T

    copies = e.withColumn("hash", F.when(F.trim("content") != "", T.normal_hash(F.col("content")))).join(E.recurrence(e).select("hash", "copies"), "hash", "left")
    unique = F.avg(F.when(F.col("copies") >= 3, 0.15).when(F.col("copies") == 2, 0.4).otherwise(0.9))
    name = F.concat(F.lit("d"), F.col("doc_id").cast("string"))
    near = docs.where("doc_id = 1").select(F.col("source").alias("of"))
    mine = docs.select("doc_id", "source").join(F.broadcast(near), F.col("source") == F.col("of"), "left_semi")  # only this source is reached
    links = mine.select(name.alias("src"), F.concat(F.lit("s"), "source").alias("dst"), F.lit(1.0).alias("weight"))
    graph = paths.diffused(links.unionByName(links.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")), spark.createDataFrame([("d1",)], "node string"), 0.85, 4)
    legs = {
        "frequency": R.lexical(docs, QUERY).select("item_id", "score"),
        "semantic": R.dense(v, R.vector_of(v, "vec_id", "embedding")),
        "template": matrix.signature_search(pages, 1, 1, LONGEST).select(F.col("doc_id").alias("item_id"), F.col("cosine").alias("score")),
        "row": matrix.search_rows(docs.withColumn("blanks", blanks), ["doc_id"], ["n_chars", "blanks"], [2000.0, 300.0]).withColumnRenamed("doc_id", "item_id"),
        "value": matrix.search_values(docs.select(F.col("doc_id").alias("item_id"), F.col("n_chars").cast("double").alias("value")), 500.0, 50.0).select("item_id", "score"),
        "recurrence": copies.groupBy(F.col("doc_id").alias("item_id")).agg(unique.alias("score")),
        "graph": graph.where(F.col("node").startswith("d")).select(F.substring("node", 2, 20).cast("long").alias("item_id"), "score"),
    }
    best = [R.top(leg, LONGEST).select(F.lit(m).alias("method"), "item_id", F.round("score", 9).alias("score")) for m, leg in legs.items()]
    scores = best[0]
    for leg in best[1:]:
        scores = scores.unionByName(leg)
    fused = fusion.reciprocal_rank(scores, fusion.normalised(WEIGHTS, list(WEIGHTS), 1.0), bounded=True)
    out = fused.select("item_id", F.round("fused", 9).alias("fused_score"), F.array_join("methods", ",").alias("methods_found"))
    # at most seven lists of 50
    return out.withColumn("final_rank", F.row_number().over(Window.orderBy(F.desc("fused_score"), "item_id"))).where("final_rank <= 25")
