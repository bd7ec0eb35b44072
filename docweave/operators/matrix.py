"""Questions about tables, and searches over their columns, rows, values and page signatures."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docweave.functions import text as T
from docweave.functions import vectors as V

# fixed values: words that name an operation, in the order they are tried, and those of numeric questions
OPERATIONS = [("sum", "total|sum|aggregate"), ("avg", "average|avg|mean"), ("max", "maximum|max|highest|largest"), ("min", "minimum|min|lowest|smallest"), ("growth", "growth|change|increase|decrease")]
NUMERIC = "total|sum|average|how much|how many|percent|growth|maximum|minimum|highest|lowest|value|amount"
DATE = r"^\s*(?:\d{4}-\d{2}-\d{2}|\d{1,2}/\d{1,2}/\d{2,4}|Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)"


def operation(question: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, words in reversed(OPERATIONS):
        out = F.when(F.lower(question).rlike(words), name).otherwise(out)
    return out


def matched_column(question: Column, headers: list[str]) -> Column:
    """The first header that is a word of the question; else the first of two letters or more within it; else the first with a
    word of four letters or more within it."""
    q = F.lower(question)
    words = T.words(question)
    first = lambda tests: F.coalesce(*(F.when(t, F.lit(h)) for h, t in zip(headers, tests)))
    long = [[w for w in h.lower().split() if len(w) > 3] for h in headers]
    return F.coalesce(
        first([F.array_contains(words, h.lower()) for h in headers]), first([F.contains(q, F.lit(h.lower())) & F.lit(len(h) > 1) for h in headers]),
        first([reduce(lambda a, b: a | b, (F.contains(q, F.lit(w)) for w in ws), F.lit(False)) for ws in long]),
    )


def answers(questions: DataFrame, wide: DataFrame, headers: dict[str, str], order: str) -> DataFrame:
    """(question, operation, header, value): the operation over the column that a question names; headers: column by header.

    One scan gives every statistic; growth is that of the last over the first value in ``order``.
    """
    named = questions.select("question", operation(F.col("question")).alias("operation"), matched_column(F.col("question"), list(headers)).alias("header"))
    stats = wide.agg(*(f.alias(f"{name}_{i}") for i, c in enumerate(headers.values()) for name, f in (
        ("sum", F.sum(c)), ("avg", F.avg(c)), ("max", F.max(c)), ("min", F.min(c)), ("growth", F.try_divide(F.max_by(c, order), F.min_by(c, order)) - 1))))
    rows = [F.struct(F.lit(h).alias("header"), F.lit(name).alias("operation"), F.col(f"{name}_{i}").cast("double").alias("value")) for i, h in enumerate(headers) for name, _ in OPERATIONS]
    known = stats.select(F.explode(F.array(*rows)).alias("r")).select("r.*")
    return named.join(F.broadcast(known), ["header", "operation"], "left").select("question", "operation", "header", "value")


def table_relevance(question: str, headers: list[str]) -> Column:
    """0.05 off tables; of tables 0.9 where a header's word stands in the question, 0.55 for numeric questions, else 0.2."""
    import re

    named = any(w in question.lower() for h in headers for w in h.lower().split() if len(w) > 2)
    of_table = 0.9 if named else 0.55 if re.search(NUMERIC, question.lower()) else 0.2
    return F.when(F.col("type") == "table", of_table).otherwise(0.05)


def column_types(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, dates, numbers, kind): "date" or "numeric" by what most of a column's values look like, else "text"."""
    as_text = [F.col(c).cast("string") for c in columns]
    counts = df.agg(F.count("*").alias("n"), *(F.count_if(c.rlike(DATE)).alias(f"d{i}") for i, c in enumerate(as_text)), *(F.count_if(T.try_numeric(c).isNotNull()).alias(f"m{i}") for i, c in enumerate(as_text)))
    kind = lambda i: F.when((F.col(f"d{i}") > F.col(f"m{i}")) & (F.col(f"d{i}") > F.col("n") * 0.5), "date").when(F.col(f"m{i}") >= F.col("n") * 0.5, "numeric").otherwise("text")
    rows = [F.struct(F.lit(c).alias("column"), F.col(f"d{i}").alias("dates"), F.col(f"m{i}").alias("numbers"), kind(i).alias("kind")) for i, c in enumerate(columns)]
    return counts.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def search_columns(cells: DataFrame, query: Column) -> DataFrame:
    """(table_id, header, score): cosine of each column with a vector given as an expression over ``row``; pre-aggregated sums."""
    sums = cells.groupBy("table_id", "header").agg(F.sum(F.col("value") * query).alias("ab"), F.sum(F.col("value") * F.col("value")).alias("aa"), F.sum(query * query).alias("bb"))
    return sums.select("table_id", "header", F.when(F.col("aa") * F.col("bb") > 0, F.col("ab") / F.sqrt(F.col("aa") * F.col("bb"))).otherwise(0.0).alias("score"))


def search_rows(wide: DataFrame, key: list[str], columns: list[str], query: list[float]) -> DataFrame:
    """(key, score): cosine of each row with a vector."""
    v = F.array(*(F.col(c).cast("double") for c in columns))
    return wide.select(*key, V.cosine(v, F.array(*(F.lit(float(x)) for x in query))).alias("score"))


def search_values(cells: DataFrame, value: float, tolerance: float) -> DataFrame:
    """Cells within the tolerance, and 1 / (1 + distance)."""
    away = F.abs(F.col("value") - value)
    return cells.where(away <= tolerance).withColumn("score", 1 / (1 + away))


def as_of(amounts: DataFrame, rates: DataFrame, by: str, at: str) -> DataFrame:
    """Amounts with ``rate``: the last of their currency that holds at their date, null before the first.

    A currency's rates are one sorted array.  Where they are counted to be few they are sent to the amounts, which are not shuffled.
    """
    listed = rates.groupBy(by).agg(F.sort_array(F.collect_list(F.struct("since", "rate"))).alias("steps"))
    j = amounts.join(F.broadcast(listed) if rates.count() <= 100_000 else listed, by, "left")
    held = F.filter("steps", lambda s: s["since"] <= F.col(at))
    return j.withColumn("rate", F.try_element_at(held, F.lit(-1))["rate"]).drop("steps")


def markdown_tables(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, first, lines, columns): runs of two or more lines that hold a bar, as tables stand in texts."""
    lines = docs.select("doc_id", F.posexplode(F.split(text, "\n")).alias("line", "content")).where(F.contains("content", F.lit("|")))
    run = F.col("line") - F.row_number().over(Window.partitionBy("doc_id").orderBy("line"))
    bars = F.size(F.split("content", r"\|")) - 1
    return lines.withColumn("run", run).withColumn("bars", bars).groupBy("doc_id", "run").agg(F.min("line").alias("first"), F.count("*").alias("lines"), F.max("bars").alias("columns")).where("lines >= 2").drop("run")


def signature_search(pages: DataFrame, doc_id: int, page: int, k: int) -> DataFrame:
    """(doc_id, page, cosine, hamming): the k pages whose signatures are nearest to one page's, and how many bits their hashes differ in."""
    row = pages.where((F.col("doc_id") == doc_id) & (F.col("page") == page)).select("signature", "content_hash").first()
    if row is None:
        return pages.select("doc_id", "page", F.lit(0.0).alias("cosine"), F.lit(0).alias("hamming")).limit(0)
    q = F.array(*(F.lit(float(x)) for x in row.signature))
    other = pages.where(~((F.col("doc_id") == doc_id) & (F.col("page") == page)))
    bits = F.bit_count(F.conv(F.substring("content_hash", 1, 8), 16, 10).cast("long").bitwiseXOR(F.lit(int(row.content_hash[:8], 16)))) + F.bit_count(F.conv(F.substring("content_hash", 9, 8), 16, 10).cast("long").bitwiseXOR(F.lit(int(row.content_hash[8:], 16))))
    return other.select("doc_id", "page", F.round(V.dot(F.col("signature"), q), 7).alias("cosine"), bits.alias("hamming")).orderBy(F.desc("cosine"), "doc_id", "page").limit(k)
