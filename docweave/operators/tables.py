"""Numeric tables as cells (table_id, row, col or header, value): statistics, growth, correlation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def statistics(value: Column) -> dict[str, Column]:
    """Sample statistics that skip nulls; 0 where there are none."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return {"sum": zero(F.sum(value)), "mean": zero(F.avg(value)), "min": zero(F.min(value)), "max": zero(F.max(value)), "median": zero(F.median(value)), "std": zero(F.stddev_samp(value)), "var": zero(F.var_samp(value)), "count": F.count(value)}


def column_statistics(cells: DataFrame, by: list[str]) -> DataFrame:
    return cells.groupBy(*by).agg(*(c.alias(n) for n, c in statistics(F.col("value")).items()))


def quantiles(cells: DataFrame, by: list[str], at: list[float]) -> DataFrame:
    """Interpolated quantiles, as columns q50 and so on."""
    return cells.groupBy(*by).agg(F.percentile("value", F.array(*map(F.lit, at))).alias("q")).select(*by, *(F.get("q", F.lit(i)).alias(f"q{round(100 * p)}") for i, p in enumerate(at)))


def growth(cells: DataFrame, by: list[str]) -> DataFrame:
    """first, last, change, rate (of the first's size), percent, annual rate over rows - 1; null if n < 2 or the first is 0."""
    known = cells.where("value IS NOT NULL").groupBy(*by).agg(F.min_by("value", "row").alias("first"), F.max_by("value", "row").alias("last"), F.count("*").alias("n"))
    usable = (F.col("n") >= 2) & (F.col("first") != 0)
    rate = F.when(usable, (F.col("last") - F.col("first")) / F.abs("first"))
    ratio = F.col("last") / F.col("first")
    return known.select(*by, "first", "last", (F.col("last") - F.col("first")).alias("change"), rate.alias("rate"), (rate * 100).alias("percent"), F.when(usable & (ratio > 0), F.pow(ratio, 1 / (F.col("n") - 1)) - 1).alias("cagr"))


def period_growth(cells: DataFrame, by: list[str]) -> DataFrame:
    """(row, rate): change from the row before, nulls passed over; rows after a 0 are left out."""
    before = F.lag("value").over(Window.partitionBy(*by).orderBy("row"))
    w = cells.where("value IS NOT NULL").withColumn("before", before).where("before != 0")
    return w.select(*by, "row", ((F.col("value") - F.col("before")) / F.abs("before")).alias("rate"))


def trend(rates: DataFrame, by: list[str], limit: float = 0.05) -> DataFrame:
    """increasing, decreasing or stable by the mean rate."""
    m = F.avg("rate")
    return rates.groupBy(*by).agg(m.alias("mean_rate"), F.when(m > limit, "increasing").when(m < -limit, "decreasing").otherwise("stable").alias("trend"))


def correlations(wide: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, pearson, covariance) of all pairs in one pass over rows; every aggregate shares the one shuffle."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    row = wide.agg(*(c for i, (a, b) in enumerate(pairs) for c in (F.corr(a, b).alias(f"r{i}"), F.covar_samp(a, b).alias(f"v{i}"))))
    return row.select(F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"r{i}").alias("pearson"), F.col(f"v{i}").alias("covariance")) for i, (a, b) in enumerate(pairs)))).alias("p")).select("p.*")


def average_ranks(df: DataFrame, column: str) -> DataFrame:
    """(value, rank): ties share their mean rank.  Ranks are counted over distinct values, of which there are fewer."""
    n = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.orderBy("value"))
    return n.select("value", (upto - (F.col("n") - 1) / 2).alias("rank"))


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """Correlation of average ranks."""
    x, y = (average_ranks(df, c).select(F.col("value").alias(c), F.col("rank").alias(f"rank_{c}")) for c in (a, b))
    return df.select(a, b).where(F.col(a).isNotNull() & F.col(b).isNotNull()).join(x, a).join(y, b).agg(F.corr(f"rank_{a}", f"rank_{b}").alias("spearman"))


def markdown(df: DataFrame, by: str, row: str, columns: list[str]) -> DataFrame:
    """(by, markdown): a table of each group's rows; one group's rows are one document's table."""
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *(F.coalesce(F.replace(F.col(c).cast("string"), F.lit("|"), F.lit("\\|")), F.lit("")) for c in columns)), F.lit(" |"))
    head = "| " + " | ".join(columns) + " |\n|" + "---|" * len(columns)
    return df.select(by, row, line.alias("line")).groupBy(by).agg(F.array_sort(F.collect_list(F.struct(row, "line"))).alias("rows")).select(by, F.concat_ws("\n", F.lit(head), F.array_join(F.transform("rows", lambda r: r["line"]), "\n")).alias("markdown"))


def parsed_markdown(text: Column) -> Column:
    """Rows of cells of a markdown table, its separator line left out, escaped bars as bars; null without a separator."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x).rlike(r"^\|.*\|$"))
    rule = lambda x: F.trim(x).rlike(r"^\|[\s:|-]+\|$")
    rows = F.transform(F.filter(lines, lambda x: ~rule(x)), lambda x: F.transform(F.split(F.regexp_replace(F.trim(x), r"^\||(?<!\\)\|$", ""), r"(?<!\\)\|"), lambda c: F.replace(F.trim(c), F.lit("\\|"), F.lit("|"))))
    return F.when(F.exists(lines, rule), rows)
