"""Questions and searches over lineitem and orders as tables, and over page signatures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.operators import elements as E
from docweave.operators import matrix as M
from docweave.plans.base import query
from docweave.plans.elements import _PAGES
from docweave.sources.relations import CELLS_SQL, ELEMENTS_SQL, cells, elements, table

QUESTIONS = ["What is the total quantity?", "average extended price per order", "highest discount", "how did tax change over time", "minimum quantity", "list the suppliers", "sum of prices", "largest order", "mean of the extended values"]
HEADERS = {"quantity": "l_quantity", "extended price": "l_extendedprice", "discount": "l_discount", "tax": "l_tax"}
_Q = "questions(question) AS (VALUES " + ", ".join(f"('{q}')" for q in QUESTIONS) + ")"
_OP = "CASE " + " ".join(f"WHEN regexp_matches(lower(question), '{words}') THEN '{name}'" for name, words in M.OPERATIONS) + " END"
_WORD = r"list_contains(regexp_extract_all(lower(question), '[\p{{L}}\p{{N}}_]+'), '{}')"
_HEADER = (
    "coalesce(" + ", ".join(f"CASE WHEN {_WORD.format(h)} THEN '{h}' END" for h in HEADERS) + ", " + ", ".join(f"CASE WHEN contains(lower(question), '{h}') THEN '{h}' END" for h in HEADERS) + ", "
    + ", ".join("CASE WHEN " + (" OR ".join(f"contains(lower(question), '{w}')" for w in h.split() if len(w) > 3) or "false") + f" THEN '{h}' END" for h in HEADERS) + ")"
)
_KNOWN = " UNION ALL ".join(
    f"SELECT '{h}' AS header, '{name}' AS operation, CAST({sql} AS DOUBLE) AS value FROM lineitem"
    for h, c in HEADERS.items() for name, sql in (("sum", f"sum({c})"), ("avg", f"avg({c})"), ("max", f"max({c})"), ("min", f"min({c})"), ("growth", f"max_by({c}, l_orderkey * 10 + l_linenumber) / min_by({c}, l_orderkey * 10 + l_linenumber) - 1"))
)


@query(f"WITH {_Q}, named AS (SELECT question, {_OP} AS operation, {_HEADER} AS header FROM questions), known AS ({_KNOWN}) SELECT question, operation, header, CASE WHEN isfinite(value) THEN round(value, 4) END AS value FROM named LEFT JOIN known USING (header, operation)")
def table_questions(spark: SparkSession, d: str) -> DataFrame:
    wide = table(spark, d, "lineitem").withColumn("at", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return M.answers(spark.createDataFrame([(q,) for q in QUESTIONS], "question string"), wide, HEADERS, "at").withColumn("value", F.round("value", 4))


@query(f"WITH {ELEMENTS_SQL} SELECT doc_id, seq, CAST(CASE WHEN type = 'table' THEN 0.55 ELSE 0.05 END AS DOUBLE) AS numeric_question, CAST(CASE WHEN type = 'table' THEN 0.9 ELSE 0.05 END AS DOUBLE) AS named_question FROM elements")
def table_relevance(spark: SparkSession, d: str) -> DataFrame:
    score = lambda q: M.table_relevance(q, ["discount rate"])
    return elements(spark, d).select("doc_id", "seq", score("How many orders were there?").alias("numeric_question"), score("Which discount is it?").alias("named_question"))


_TYPED = ["o_orderkey", "o_totalprice", "o_orderdate", "o_orderstatus", "o_orderpriority"]
_NUM = r"'^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$'"
_COUNTS = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) AS n, count(*) FILTER (regexp_matches(CAST({c} AS VARCHAR), '{M.DATE}')) AS dates, count(*) FILTER (regexp_matches(CAST({c} AS VARCHAR), {_NUM})) AS numbers FROM orders" for c in _TYPED)


@query(f"WITH c AS ({_COUNTS}) SELECT \"column\", dates, numbers, CASE WHEN dates > numbers AND dates > n * 0.5 THEN 'date' WHEN numbers >= n * 0.5 THEN 'numeric' ELSE 'text' END AS kind FROM c")
def column_types(spark: SparkSession, d: str) -> DataFrame:
    return M.column_types(table(spark, d, "orders"), _TYPED)


@query(f'WITH {CELLS_SQL}, v AS (SELECT table_id, header, value, "row" % 7 + 1 AS q FROM cells) SELECT table_id, header, round(sum(value * q) / sqrt(sum(value * value) * sum(q * q)), 6) AS score FROM v GROUP BY 1, 2 ORDER BY score DESC, table_id, header LIMIT 10')
def column_search(spark: SparkSession, d: str) -> DataFrame:
    s = M.search_columns(cells(spark, d), (F.col("row") % 7 + 1).cast("double"))
    return s.select("table_id", "header", F.round("score", 6).alias("score")).orderBy(F.desc("score"), "table_id", "header").limit(10)


_ROWQ = [20.0, 30000.0, 0.05, 0.02]
_NORM_Q = "sqrt(" + " + ".join(f"CAST({x} AS DOUBLE) * {x}" for x in _ROWQ) + ")"


@query(f"WITH s AS (SELECT l_orderkey, l_linenumber, round((l_quantity * {_ROWQ[0]} + l_extendedprice * {_ROWQ[1]} + l_discount * {_ROWQ[2]} + l_tax * {_ROWQ[3]}) / (sqrt(l_quantity * l_quantity + l_extendedprice * l_extendedprice + l_discount * l_discount + l_tax * l_tax) * {_NORM_Q}), 9) AS score FROM lineitem) SELECT l_orderkey, l_linenumber, score FROM s ORDER BY score DESC, l_orderkey, l_linenumber LIMIT 20")
def row_search(spark: SparkSession, d: str) -> DataFrame:
    s = M.search_rows(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], list(HEADERS.values()), _ROWQ)
    return s.withColumn("score", F.round("score", 9)).orderBy(F.desc("score"), "l_orderkey", "l_linenumber").limit(20)


@query(f'WITH {CELLS_SQL} SELECT table_id, "row", header, value, round(1 / (1 + abs(value - 40)), 6) AS score FROM cells WHERE abs(value - 40) <= 2.5 ORDER BY score DESC, table_id, "row", header LIMIT 50')
def value_search(spark: SparkSession, d: str) -> DataFrame:
    s = M.search_values(cells(spark, d), 40.0, 2.5)
    return s.select("table_id", "row", "header", "value", F.round("score", 6).alias("score")).orderBy(F.desc("score"), "table_id", "row", "header").limit(50)


@query("WITH t AS (SELECT l_returnflag AS table_id, count(*) AS n FROM lineitem GROUP BY 1) SELECT table_id, n * 4 AS cells FROM t ORDER BY cells DESC, table_id LIMIT 1")
def largest_table(spark: SparkSession, d: str) -> DataFrame:
    return cells(spark, d).groupBy("table_id").agg(F.count("*").alias("cells")).orderBy(F.desc("cells"), "table_id").limit(1)


#: A rate for each status and every other month, by a rule.
@query("""WITH m AS (SELECT DISTINCT o_orderstatus, date_trunc('month', o_orderdate) AS since FROM orders), rates AS (SELECT o_orderstatus, since, 1 + (month(since) * 7 % 13) / CAST(100 AS DOUBLE) AS rate FROM m WHERE month(since) % 2 = 0)
SELECT o_orderkey, round(o.o_totalprice * rate, 4) AS converted FROM orders o ASOF LEFT JOIN rates r ON o.o_orderstatus = r.o_orderstatus AND o.o_orderdate >= r.since""")
def converted_amounts(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders")
    months = orders.select("o_orderstatus", F.date_trunc("month", "o_orderdate").alias("since")).distinct()
    rates = months.where(F.month("since") % 2 == 0).withColumn("rate", 1 + (F.month("since") * 7 % 13) / 100.0)
    return M.as_of(orders, rates, "o_orderstatus", "o_orderdate").select("o_orderkey", F.round(F.col("o_totalprice") * F.col("rate"), 4).alias("converted"))


@query(r"""WITH l AS (SELECT doc_id, unnest(range(0, len(p))) AS line, unnest(p) AS content FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents)), b AS (SELECT *, line - row_number() OVER (PARTITION BY doc_id ORDER BY line) AS run FROM l WHERE contains(content, '|'))
SELECT doc_id, CAST(min(line) AS INTEGER) AS "first", count(*) AS lines, CAST(max(len(string_split(content, '|')) - 1) AS INTEGER) AS columns FROM b GROUP BY doc_id, run HAVING count(*) >= 2""")
def tables_in_texts(spark: SparkSession, d: str) -> DataFrame:
    return M.markdown_tables(table(spark, d, "documents"))


_BITS = " + ".join(f"bit_count(xor(CAST('0x' || substr(p.content_hash, {a}, 8) AS BIGINT), CAST('0x' || substr(q.content_hash, {a}, 8) AS BIGINT)))" for a in (1, 9))


@query(f"{_PAGES}, q AS (SELECT signature, content_hash FROM page_signatures WHERE doc_id = 1 AND page = 1) SELECT doc_id, page, round(list_dot_product(p.signature, q.signature), 7) AS cosine, CAST({_BITS} AS INTEGER) AS hamming FROM page_signatures p, q WHERE NOT (doc_id = 1 AND page = 1) ORDER BY cosine DESC, doc_id, page LIMIT 10")
def similar_pages(spark: SparkSession, d: str) -> DataFrame:
    return M.signature_search(E.page_signatures(elements(spark, d)), 1, 1, 10)
