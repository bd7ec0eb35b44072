"""Matrices and tensors as coordinates, signals, choice under a budget, information quantities."""

from __future__ import annotations



import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def mode_sum(t: DataFrame, keep: list[str], size: int | None = None) -> DataFrame:
    """A tensor summed (or, given the mode's size, averaged) over the modes not kept; absent cells are zeros."""
    s = t.groupBy(*keep).agg(F.sum("value").alias("value"))
    return s if size is None else s.withColumn("value", F.col("value") / size)


def contract(a: DataFrame, b: DataFrame, on: str, left: list[str], right: list[str]) -> DataFrame:
    """Sum over the shared mode of products: a join and a sum, pre-aggregated before the second shuffle."""
    x = a.select(on, *left, F.col("value").alias("x"))
    return x.join(b.select(on, *right, F.col("value").alias("y")), on).groupBy(*left, *right).agg(F.sum(F.col("x") * F.col("y")).alias("value"))


def norms(t: DataFrame) -> DataFrame:
    return t.agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("frobenius"), F.sum(F.abs("value")).alias("l1"), F.max(F.abs("value")).alias("l_inf"), F.count("*").alias("cells"))


def haar(signal: DataFrame, by: list[str], position: str, value: str) -> DataFrame:
    """(by..., k, approximation, detail): level one; an odd end repeats its last value."""
    pair = signal.groupBy(*by, F.floor(F.col(position) / 2).alias("k")).agg(F.min_by(value, position).alias("a"), F.max_by(value, position).alias("b"))
    return pair.select(*by, "k", ((F.col("a") + F.col("b")) / F.sqrt(F.lit(2.0))).alias("approximation"), ((F.col("a") - F.col("b")) / F.sqrt(F.lit(2.0))).alias("detail"))


def dft(signal: DataFrame, by: list[str], position: str, value: str, n: int) -> DataFrame:
    """(by..., k, re, im): coefficients of a signal of n places, as sums over places."""
    k = signal.select(*by, F.col(position).alias("t"), F.col(value).alias("v"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("k"))
    angle = -2 * np.pi * F.col("k") * F.col("t") / n
    return k.groupBy(*by, "k").agg(F.sum(F.col("v") * F.cos(angle)).alias("re"), F.sum(F.col("v") * F.sin(angle)).alias("im"))


def mutual_information(joint: DataFrame, a: str, b: str, n: str) -> DataFrame:
    """Bits that two columns of a count table share."""
    total = joint.agg(F.sum(n).alias("total"))
    pa, pb = (joint.groupBy(c).agg(F.sum(n).alias(f"n_{c}")) for c in (a, b))
    j = joint.join(F.broadcast(total)).join(pa, a).join(pb, b)
    return j.agg(F.sum(F.col(n) / F.col("total") * F.log2(F.col(n) * F.col("total") / (F.col(f"n_{a}") * F.col(f"n_{b}")))).alias("bits"))


def skyline(df: DataFrame, key: str, up: str, down: str) -> DataFrame:
    """Rows that no other beats in both: ``up`` the greater the better, ``down`` the smaller.

    A row stays if its ``up`` exceeds the best among all rows of smaller ``down``.  Best values are kept per distinct ``down``,
    so what is ordered is as long as that column has values, not as the table.
    """
    from pyspark.sql import Window

    best = df.groupBy(down).agg(F.max(up).alias("best"))
    before = F.max("best").over(Window.orderBy(down).rowsBetween(Window.unboundedPreceding, -1))
    front = best.withColumn("before", before).where(F.col("before").isNull() | (F.col("best") > F.col("before")))
    return df.join(front.select(down, F.col("best").alias(up)), [down, up], "left_semi").select(key, up, down)



def greedy_knapsack(value: np.ndarray, size: np.ndarray, budget: int) -> np.ndarray:
    """By value for size, skipping what no longer fits; the best single item instead if that is worth more."""
    left, chosen = budget, []
    for i in np.lexsort((np.arange(len(value)), -value / np.maximum(size, 1))):
        if size[i] <= left:
            chosen.append(i)
            left -= size[i]
    fits = np.flatnonzero(size <= budget)
    if len(fits) and value[fits].max() > value[chosen].sum():
        return np.array([fits[np.argmax(value[fits])]])
    return np.array(chosen, dtype=int)


def exact_knapsack(value: np.ndarray, size: np.ndarray, budget: int) -> np.ndarray:
    best = np.zeros(budget + 1)
    took = np.zeros((len(value), budget + 1), dtype=bool)
    for i, (v, s) in enumerate(zip(value, size)):
        if s <= budget:
            other = np.concatenate((np.full(s, -np.inf), best[: budget + 1 - s] + v))
            took[i] = other > best
            best = np.maximum(best, other)
    chosen, left = [], budget
    for i in range(len(value) - 1, -1, -1):
        if took[i, left]:
            chosen.append(i)
            left -= size[i]
    return np.array(chosen[::-1], dtype=int)


def knapsack(candidates: DataFrame, by: str, key: str, budget: int, exact: bool) -> DataFrame:
    """(by, key): what to take of each group's candidates (value, size) within the budget.

    Of one size at most budget / size candidates can be taken, those of most value: the others go before the groups meet, so a
    group in memory has at most about budget x ln(budget) candidates, however many there are.
    """
    from pyspark.sql import Window

    solve = exact_knapsack if exact else greedy_knapsack
    nth = F.row_number().over(Window.partitionBy(by, "size").orderBy(F.desc("value"), key))
    candidates = candidates.where(F.col("size") <= budget).withColumn("nth", nth).where((F.col("size") <= 0) | (F.col("nth") * F.col("size") <= budget))
    kinds = dict(candidates.dtypes)

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key)
        return pdf.iloc[np.sort(solve(pdf["value"].to_numpy(float), pdf["size"].to_numpy(int), budget))][[by, key]]

    return candidates.select(by, key, "value", "size").groupBy(by).applyInPandas(pick, f"{by} {kinds[by]}, {key} {kinds[key]}")


def fit_in_budget(items: DataFrame, by: str, order: list[Column], size: str, budget: int) -> DataFrame:
    """With ``used``, the running size in order; rows within the budget."""
    from pyspark.sql import Window

    return items.withColumn("used", F.sum(size).over(Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))).where(F.col("used") <= budget)


def spectrum(edges: DataFrame, by: str, k: int) -> DataFrame:
    """(by, i, eigenvalue): least eigenvalues of each group's Laplacian.

    The m nodes that hang on one node alone by the same weight w give the eigenvalue w m - 1 times, on vectors that are zero
    elsewhere; on all others they act as one node, tied by w times the root of m.  So leaves are counted, and a task holds only a
    graph's other nodes.
    """
    e = edges.groupBy(by, F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(F.max("weight").alias("weight"))
    both = F.array(F.struct(F.col("src").alias("node"), F.col("dst").alias("other")), F.struct(F.col("dst").alias("node"), F.col("src").alias("other")))
    ends = e.select(by, "weight", F.explode(both).alias("e")).groupBy(by, F.col("e.node").alias("node")).agg(F.count("*").alias("n"), F.min("e.other").alias("other"), F.min("weight").alias("weight"))
    inner = ends.where("n > 1").select(by, F.col("node").alias("other"))
    leaves = ends.where("n = 1").join(inner, [by, "other"], "left_semi")
    twins = leaves.groupBy(by, F.col("other").alias("src"), "weight").agg(F.min("node").alias("dst"), F.count("*").alias("m"))
    core = e
    for c in ("src", "dst"):
        core = core.join(leaves.select(by, F.col("node").alias(c)), [by, c], "left_anti")
    held = core.withColumn("m", F.lit(1).cast("long")).unionByName(twins)

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        names = sorted(set(pdf["src"]) | set(pdf["dst"]))
        at = {n: i for i, n in enumerate(names)}
        a, more = np.zeros((len(names), len(names))), []
        for s, t, w, m in zip(pdf["src"], pdf["dst"], pdf["weight"], pdf["m"]):
            if s != t:
                a[at[s], at[t]] = a[at[t], at[s]] = -w * np.sqrt(m)
                a[at[s], at[s]] += w * m
                a[at[t], at[t]] += w
                more += [w] * min(m - 1, k)
        values = np.sort(np.concatenate([np.linalg.eigvalsh(a), more]))[:k]
        return pd.DataFrame({by: pdf[by].iloc[0], "i": np.arange(len(values), dtype=np.int32), "eigenvalue": np.round(values, 9)})

    return held.select(by, "src", "dst", "weight", "m").groupBy(by).applyInPandas(solve, f"{by} {dict(edges.dtypes)[by]}, i int, eigenvalue double")
