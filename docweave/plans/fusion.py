"""Fusion of three scores of every document: its length, its blanks and how often it has the commonest letter."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.operators import fusion as Fu
from docweave.plans.base import query
from docweave.sources.relations import table

WEIGHTS = {"length": 0.5, "blanks": 0.3, "letters": 0.2}
_SCORES = """scores AS (SELECT 'length' AS method, doc_id AS item_id, CAST(n_chars AS DOUBLE) AS score FROM documents UNION ALL SELECT 'blanks', doc_id, length(text) - length(replace(text, ' ', '')) FROM documents
 UNION ALL SELECT 'letters', doc_id, (length(text) - length(replace(text, 'e', ''))) / (1 + CAST(length(text) AS DOUBLE)) FROM documents),
w(method, w) AS (VALUES ('length', CAST(0.5 AS DOUBLE)), ('blanks', 0.3), ('letters', 0.2)),
ranked AS (SELECT s.*, w, row_number() OVER (PARTITION BY method ORDER BY score DESC, item_id) AS rank FROM scores s JOIN w USING (method)),
scaled AS (SELECT method, item_id, w, (score - min(score) OVER p) / CASE WHEN max(score) OVER p - min(score) OVER p < 1e-12 THEN 1 ELSE max(score) OVER p - min(score) OVER p END AS score FROM ranked WINDOW p AS (PARTITION BY method))"""


def scores(spark: SparkSession, d: str) -> DataFrame:
    without = lambda c: F.length("text") - F.length(F.replace("text", F.lit(c), F.lit("")))
    legs = {"length": F.col("n_chars").cast("double"), "blanks": without(" ").cast("double"), "letters": without("e") / (1 + F.length("text"))}
    each = F.explode(F.array(*(F.struct(F.lit(m).alias("method"), s.alias("score")) for m, s in legs.items()))).alias("leg")
    return table(spark, d, "documents").select(F.col("doc_id").alias("item_id"), each).select("leg.method", "item_id", "leg.score")


def rounded(df: DataFrame) -> DataFrame:
    return df.select("item_id", F.round("fused", 6).alias("fused"))


@query(f"WITH {_SCORES} SELECT item_id, round(sum(w / (60 + rank)), 6) AS fused FROM ranked GROUP BY 1")
def rrf_fusion(spark: SparkSession, d: str) -> DataFrame:
    return rounded(Fu.reciprocal_rank(scores(spark, d), WEIGHTS))


@query(f"WITH {_SCORES} SELECT item_id, round(sum(w / (60 + rank - 1)), 6) AS fused FROM ranked GROUP BY 1")
def rrf_from_zero(spark: SparkSession, d: str) -> DataFrame:
    return rounded(Fu.reciprocal_rank(scores(spark, d), WEIGHTS, first=0))


@query(f"WITH {_SCORES}, n AS (SELECT count(DISTINCT item_id) AS n FROM scores) SELECT item_id, round(sum(w * greatest(n - rank, 0)), 6) AS fused FROM ranked, n GROUP BY 1")
def borda_fusion(spark: SparkSession, d: str) -> DataFrame:
    return rounded(Fu.borda(scores(spark, d), WEIGHTS))


@query(f"WITH {_SCORES}, n AS (SELECT count(DISTINCT item_id) AS n FROM scores) SELECT item_id, round(sum(w * greatest(n - rank + 1, 0)), 6) AS fused FROM ranked, n GROUP BY 1")
def borda_last_counts(spark: SparkSession, d: str) -> DataFrame:
    return rounded(Fu.borda(scores(spark, d), WEIGHTS, last=1))


@query(f"WITH {_SCORES} SELECT item_id, round(sum(w * score), 6) AS fused FROM scaled GROUP BY 1")
def weighted_sum_fusion(spark: SparkSession, d: str) -> DataFrame:
    return rounded(Fu.weighted_sum(scores(spark, d), WEIGHTS))


@query(f"WITH {_SCORES} SELECT item_id, round(sum(w * lower), 6) AS fused FROM (SELECT s.item_id, w, rank() OVER (PARTITION BY method ORDER BY score) - 1 AS lower FROM scores s JOIN w USING (method)) GROUP BY 1")
def strict_wins_fusion(spark: SparkSession, d: str) -> DataFrame:
    return rounded(Fu.strict_wins(scores(spark, d), WEIGHTS))


@query(f"""WITH {_SCORES}, items AS (SELECT DISTINCT item_id FROM ranked WHERE rank <= 60), best AS (SELECT * FROM ranked WHERE rank <= 60), r AS (SELECT i.item_id, w.method, w.w, coalesce(rank, 999999) AS rank FROM items i CROSS JOIN w LEFT JOIN best k ON k.item_id = i.item_id AND k.method = w.method),
m AS (SELECT a.item_id, b.item_id AS other, round(sum(a.w * sign(b.rank - a.rank)), 9) AS margin FROM r a JOIN r b ON a.method = b.method AND a.item_id <> b.item_id GROUP BY 1, 2),
s AS (SELECT item_id, sum(sign(margin)) AS score FROM m GROUP BY 1) SELECT item_id, round((score - min(score) OVER ()) / (max(score) OVER () - min(score) OVER ()), 6) AS fused FROM s""")
def copeland_fusion(spark: SparkSession, d: str) -> DataFrame:
    return rounded(Fu.copeland(scores(spark, d), WEIGHTS))


@query(f"WITH {_SCORES} SELECT method, item_id, CAST(rank AS INTEGER) AS rank, round(score * pow(CAST(0.95 AS DOUBLE), rank - 1), 3) AS score FROM ranked")
def positional_scores(spark: SparkSession, d: str) -> DataFrame:
    return Fu.positional(scores(spark, d)).withColumn("score", F.round("score", 3))


@query(f"WITH {_SCORES}, s AS (SELECT item_id, sum(w * score) AS composite, stddev_pop(score) AS spread FROM scaled GROUP BY 1) SELECT item_id, round(composite, 6) AS composite, round(spread, 6) AS spread, round(composite * (1 - spread / max(spread) OVER ()), 6) AS confidence FROM s")
def fusion_confidence(spark: SparkSession, d: str) -> DataFrame:
    s = Fu.agreement(scores(spark, d), WEIGHTS)
    return s.select("item_id", *(F.round(c, 6).alias(c) for c in ("composite", "spread", "confidence")))
