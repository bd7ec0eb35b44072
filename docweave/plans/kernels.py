"""Folds over daily series, games, hulls and factors of small matrices."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.operators import kernels as K
from docweave.operators import numeric as N
from docweave.plans.base import query
from docweave.sources.relations import table

_DAYS = "WITH RECURSIVE days AS (SELECT event_type, CAST(ts AS DATE) AS day, round(avg(value), 6) AS v FROM events GROUP BY 1, 2), s AS (SELECT event_type, v, row_number() OVER (PARTITION BY event_type ORDER BY day) AS n FROM days)"
_CLIP = "greatest(-50, least(50, {}))"


@query(f"""{_DAYS}, c AS (SELECT event_type, n, CAST({_CLIP.format('50 - v')} AS DOUBLE) AS total, 50 - v AS e, CAST({_CLIP.format('0.6 * (50 - v) + 0.1 * ' + _CLIP.format('50 - v'))} AS DOUBLE) AS out FROM s WHERE n = 1
 UNION ALL SELECT s.event_type, s.n, {_CLIP.format('c.total + 50 - v')}, 50 - v, {_CLIP.format('0.6 * (50 - v) + 0.1 * ' + _CLIP.format('c.total + (50 - v)') + ' + 0.05 * (50 - v - c.e)')} FROM c JOIN s ON s.event_type = c.event_type AND s.n = c.n + 1)
SELECT event_type, count(*) AS days, round(sum(out), 4) AS total, round(arg_max(out, n), 4) AS last FROM c GROUP BY 1""")
def controlled_series(spark: SparkSession, d: str) -> DataFrame:
    s = K.daily(table(spark, d, "events"), "event_type", "value").withColumn("out", K.controller(F.col("series"), 50.0))
    return s.select("event_type", F.size("out").cast("long").alias("days"), F.round(F.aggregate("out", F.lit(0.0), lambda a, x: a + x), 4).alias("total"), F.round(F.element_at("out", -1), 4).alias("last"))


@query(f"""{_DAYS}, c AS (SELECT event_type, n, CAST(v AS DOUBLE) AS x, 0.5 * v AS y, CAST(0 AS DOUBLE) AS out FROM s WHERE n = 1 UNION ALL SELECT s.event_type, s.n, 0.8 * c.x + 0.1 * c.y + v, -0.2 * c.x + 0.7 * c.y + 0.5 * v, c.x - 2 * c.y FROM c JOIN s ON s.event_type = c.event_type AND s.n = c.n + 1)
SELECT event_type, round(arg_max(out, n), 4) AS last, round(max(out), 4) AS most FROM c GROUP BY 1""")
def simulated_system(spark: SparkSession, d: str) -> DataFrame:
    s = K.daily(table(spark, d, "events"), "event_type", "value").withColumn("out", K.linear_system(F.col("series"), [[0.8, 0.1], [-0.2, 0.7]], [1.0, 0.5], [1.0, -2.0]))
    return s.select("event_type", F.round(F.element_at("out", -1), 4).alias("last"), F.round(F.array_max("out"), 4).alias("most"))


@query(f"""{_DAYS}, c AS (SELECT event_type, n, 0.01 * (v - 50) / 50 AS m, greatest(0.001, least(0.5, 0.1 + 0.01 * (v - 50) / 50)) AS w, 0.1 * v AS q FROM s WHERE n = 1
 UNION ALL SELECT s.event_type, s.n, 0.9 * c.m + 0.01 * (v - 50) / 50, greatest(0.001, least(0.5, c.w + 0.9 * c.m + 0.01 * (v - 50) / 50)), c.q + 0.1 * (v + 0.9 * c.q - c.q) FROM c JOIN s ON s.event_type = c.event_type AND s.n = c.n + 1)
SELECT event_type, round(arg_max(w, n), 6) AS weight, round(arg_max(q, n), 4) AS value FROM c GROUP BY 1""")
def learned_weights(spark: SparkSession, d: str) -> DataFrame:
    s = K.daily(table(spark, d, "events"), "event_type", "value")
    signal = F.transform("series", lambda v: (v - 50) / 50)
    return s.select("event_type", F.round(K.momentum(signal), 6).alias("weight"), F.round(K.temporal_difference(F.col("series")), 4).alias("value"))


@query("""WITH RECURSIVE c AS (SELECT n_nationkey, 2.5 + n_nationkey / CAST(25 AS DOUBLE) AS r, CAST(0.4 AS DOUBLE) AS x, CAST(0 AS DOUBLE) AS s, 0 AS i FROM nation UNION ALL SELECT n_nationkey, r, r * x * (1 - x), s + CASE WHEN i + 1 > 10 THEN ln(greatest(abs(r * (1 - 2 * x)), 1e-12)) ELSE 0 END, i + 1 FROM c WHERE i < 40)
SELECT n_nationkey, round(s / 30, 4) AS exponent FROM c WHERE i = 40""")
def logistic_exponents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nation").select("n_nationkey", F.round(K.logistic_exponent(2.5 + F.col("n_nationkey") / 25.0, 0.4, 40, 10), 4).alias("exponent"))


@query("SELECT n_nationkey, round(1 / (1 + 9 * exp(-(1 + n_nationkey / CAST(25 AS DOUBLE)) * 2)), 5) AS y FROM nation")
def grown_values(spark: SparkSession, d: str) -> DataFrame:
    """Runge-Kutta agrees with the closed solution of logistic growth to the digits shown."""
    return table(spark, d, "nation").select("n_nationkey", F.round(K.runge_kutta(1 + F.col("n_nationkey") / 25.0, F.lit(0.1), 0.02, 100), 5).alias("y"))


@query("""WITH p AS (SELECT n_regionkey, CAST(n_nationkey AS DOUBLE) AS x, CAST(length(n_name) AS DOUBLE) AS y FROM nation), t AS (SELECT a.n_regionkey, a.x, a.y, product(CASE WHEN a.x <> b.x THEN (7.5 - b.x) / (a.x - b.x) ELSE 1 END) AS l FROM p a JOIN p b USING (n_regionkey) GROUP BY 1, 2, 3)
SELECT n_regionkey, round(sum(y * l), 4) AS value FROM t GROUP BY 1""")
def interpolated_values(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "nation").select("n_regionkey", F.col("n_nationkey").cast("double").alias("x"), F.length("n_name").cast("double").alias("y"))
    return K.interpolated(p, "n_regionkey", "x", "y", 7.5).withColumn("value", F.round("value", 4))


@query("SELECT o_orderpriority, round(sum((epoch(next_at) - epoch(o_orderdate)) / 86400.0 * (v + next_v) / 2), 2) AS area FROM (SELECT *, lead(o_orderdate) OVER p AS next_at, lead(v) OVER p AS next_v FROM (SELECT o_orderpriority, o_orderdate, avg(o_totalprice) AS v FROM orders GROUP BY 1, 2) WINDOW p AS (PARTITION BY o_orderpriority ORDER BY o_orderdate)) GROUP BY 1")
def areas_under_series(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    days = table(spark, d, "orders").groupBy("o_orderpriority", "o_orderdate").agg(F.avg("o_totalprice").alias("v"))
    w = Window.partitionBy("o_orderpriority").orderBy("o_orderdate")  # a row for each day
    n = days.withColumns({"next_at": F.lead("o_orderdate").over(w), "next_v": F.lead("v").over(w)})
    width = (F.unix_timestamp(F.col("next_at").cast("timestamp")) - F.unix_timestamp(F.col("o_orderdate").cast("timestamp"))) / 86400.0
    return n.groupBy("o_orderpriority").agg(F.round(F.sum(width * (F.col("v") + F.col("next_v")) / 2), 2).alias("area"))


_A = ["n_nationkey % 5", "n_nationkey % 3", "n_nationkey % 7", "n_nationkey % 4"]
_B = ["n_nationkey % 3", "n_nationkey % 6", "n_nationkey % 5", "n_nationkey % 2"]


@query(f"""WITH g AS (SELECT n_nationkey, {', '.join(f'CAST({x} AS DOUBLE) AS a{i}' for i, x in enumerate(_A))}, {', '.join(f'CAST({x} AS DOUBLE) AS b{i}' for i, x in enumerate(_B))} FROM nation),
m AS (SELECT *, CASE WHEN b0 - b1 - b2 + b3 <> 0 THEN (b3 - b2) / (b0 - b1 - b2 + b3) END AS p, CASE WHEN a0 - a1 - a2 + a3 <> 0 THEN (a3 - a1) / (a0 - a1 - a2 + a3) END AS q FROM g)
SELECT n_nationkey, CAST((a0 >= a2 AND b0 >= b1) AS INTEGER) + CAST((a1 >= a3 AND b1 >= b0) AS INTEGER) + CAST((a2 >= a0 AND b2 >= b3) AS INTEGER) + CAST((a3 >= a1 AND b3 >= b2) AS INTEGER) AS pure, round(CASE WHEN p BETWEEN 0 AND 1 THEN p END, 6) AS first_plays_first, round(CASE WHEN q BETWEEN 0 AND 1 THEN q END, 6) AS second_plays_first FROM m""")
def game_equilibria(spark: SparkSession, d: str) -> DataFrame:
    payoffs = [[F.expr(x).cast("double") for x in xs] for xs in (_A, _B)]
    return table(spark, d, "nation").select("n_nationkey", *((F.round(c, 6) if k != "pure" else c).alias(k) for k, c in K.equilibrium(*payoffs).items()))


@query()
def customer_hulls(spark: SparkSession, d: str) -> DataFrame:
    points = table(spark, d, "customer").select("c_mktsegment", (F.col("c_custkey") % 101).cast("double").alias("px"), F.col("c_acctbal").alias("py"))
    return K.hull(points, "c_mktsegment", "px", "py")


_G = "g AS (SELECT sum(l_quantity * l_quantity) AS a, sum(l_quantity * l_discount) AS b, sum(l_discount * l_discount) AS c, sum(l_quantity * l_tax) AS d, sum(l_discount * l_tax) AS e, sum(l_tax * l_tax) AS f FROM lineitem)"


@query(f"""WITH {_G}, l AS (SELECT sqrt(a) AS l00, b / sqrt(a) AS l10, d / sqrt(a) AS l20, sqrt(c - b * b / a) AS l11, (e - d * b / a) / sqrt(c - b * b / a) AS l21, a, b, c, d, e, f FROM g)
SELECT * FROM (SELECT 0 AS row, 0 AS col, round(l00, 4) AS value FROM l UNION ALL SELECT 1, 0, round(l10, 4) FROM l UNION ALL SELECT 2, 0, round(l20, 4) FROM l UNION ALL SELECT 1, 1, round(l11, 4) FROM l UNION ALL SELECT 2, 1, round(l21, 4) FROM l UNION ALL SELECT 2, 2, round(sqrt(f - l20 * l20 - l21 * l21), 4) FROM l)""")
def gram_cholesky(spark: SparkSession, d: str) -> DataFrame:
    return K.cholesky(table(spark, d, "lineitem"), ["l_quantity", "l_discount", "l_tax"]).withColumn("value", F.round("value", 4))


#: A tensor of order values by status, priority and year.
_TENSOR = "t AS (SELECT o_orderstatus AS i, o_orderpriority AS j, year(o_orderdate) AS k, sum(o_totalprice) AS v FROM orders GROUP BY 1, 2, 3)"


def tensor(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("i"), F.col("o_orderpriority").alias("j"), F.year("o_orderdate").alias("k")).agg(F.sum("o_totalprice").alias("v"))


@query(f"WITH {_TENSOR} SELECT i AS row, j || '/' || k AS col, round(v, 2) AS value FROM t")
def unfolded_tensor(spark: SparkSession, d: str) -> DataFrame:
    return tensor(spark, d).select(F.col("i").alias("row"), F.concat_ws("/", "j", F.col("k").cast("string")).alias("col"), F.round("v", 2).alias("value"))


@query(f"WITH {_TENSOR} SELECT i, j, CAST(m AS INTEGER) AS m, round(sum(v * CASE WHEN k % 3 = m THEN 1.0 ELSE 0.25 END), 4) AS value FROM t, range(3) AS r(m) GROUP BY 1, 2, 3")
def mode_product(spark: SparkSession, d: str) -> DataFrame:
    t = tensor(spark, d)
    years = t.select("k").distinct()
    matrix = years.select("k", F.explode(F.array(*(F.struct(F.lit(m).alias("m"), F.when(F.col("k") % 3 == m, 1.0).otherwise(0.25).alias("value")) for m in range(3)))).alias("e")).select("k", "e.m", "e.value")
    return N.contract(t.withColumnRenamed("v", "value"), matrix, "k", ["i", "j"], ["m"]).withColumn("value", F.round("value", 4))


@query(f"WITH {_TENSOR}, a AS (SELECT i, k, sum(v) AS v FROM t GROUP BY 1, 2), b AS (SELECT j, k, sum(v) AS v FROM t GROUP BY 1, 2) SELECT i, j, k, round(a.v * b.v / 1e12, 4) AS value FROM a JOIN b USING (k)")
def columnwise_kronecker(spark: SparkSession, d: str) -> DataFrame:
    t = tensor(spark, d)
    a, b = (t.groupBy(x, "k").agg(F.sum("v").alias(f"v{x}")) for x in ("i", "j"))
    return a.join(b, "k").select("i", "j", "k", F.round(F.col("vi") * F.col("vj") / 1e12, 4).alias("value"))


@query(f"WITH {_TENSOR}, a AS (SELECT i, j, sum(v) AS v FROM t WHERE k < 1996 GROUP BY 1, 2), b AS (SELECT i, j, sum(v) AS v FROM t WHERE k >= 1996 GROUP BY 1, 2) SELECT i, j, round(a.v * b.v / 1e12, 4) AS value FROM a JOIN b USING (i, j)")
def elementwise_product(spark: SparkSession, d: str) -> DataFrame:
    t = tensor(spark, d)
    a, b = (t.where(c).groupBy("i", "j").agg(F.sum("v").alias(n)) for n, c in (("va", "k < 1996"), ("vb", "k >= 1996")))
    return a.join(b, ["i", "j"]).select("i", "j", F.round(F.col("va") * F.col("vb") / 1e12, 4).alias("value"))
