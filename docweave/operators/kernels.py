"""Numeric kernels over bounded groups, and folds over ordered series: each group's input is a matrix, a series or a candidate list
whose size a caller bounds (a day's values of a type, a component, a table's columns), never a whole corpus."""

from __future__ import annotations

from functools import reduce
from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def daily(events: DataFrame, by: str, value: str) -> DataFrame:
    """(by, series): the mean of each day, in order; pre-aggregated, so a series is as long as there are days."""
    days = events.groupBy(by, F.to_date("ts").alias("day")).agg(F.round(F.avg(value), 6).alias("v"))
    return days.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("day", "v"))), lambda x: x["v"]).alias("series"))


def clip(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def controller(series: Column, target: float, kp: float = 0.6, ki: float = 0.1, kd: float = 0.05, limit: float = 50.0) -> Column:
    """Outputs of a PID controller with a bounded integral: a fold over the measurements."""
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(None).cast("double").alias("last"), F.array().cast("array<double>").alias("out"))

    def step(a: Column, v: Column) -> Column:
        e = F.lit(target) - v
        total = clip(a["sum"] + e, -limit, limit)
        out = clip(kp * e + ki * total + kd * (e - F.coalesce(a["last"], e)), -limit, limit)
        return F.struct(total.alias("sum"), e.alias("last"), F.concat(a["out"], F.array(out)).alias("out"))

    return F.aggregate(series, start, step, lambda a: a["out"])


def linear_system(series: Column, a: list[list[float]], b: list[float], c: list[float]) -> Column:
    """Outputs c.x of x' = a x + b u, two states, for inputs u."""
    start = F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.array().cast("array<double>").alias("out"))

    def step(s: Column, u: Column) -> Column:
        x, y = a[0][0] * s["x"] + a[0][1] * s["y"] + b[0] * u, a[1][0] * s["x"] + a[1][1] * s["y"] + b[1] * u
        return F.struct(x.alias("x"), y.alias("y"), F.concat(s["out"], F.array(c[0] * s["x"] + c[1] * s["y"])).alias("out"))

    return F.aggregate(series, start, step, lambda s: s["out"])


def momentum(series: Column, rate: float = 0.01, keep: float = 0.9, low: float = 0.001, high: float = 0.5) -> Column:
    """A weight moved along signals by momentum, within bounds; starts at 0.1."""
    start = F.struct(F.lit(0.0).alias("v"), F.lit(0.1).alias("w"))

    def step(a: Column, g: Column) -> Column:
        v = keep * a["v"] + rate * g
        return F.struct(v.alias("v"), clip(a["w"] + v, low, high).alias("w"))

    return F.aggregate(series, start, step, lambda a: a["w"])


def temporal_difference(rewards: Column, rate: float = 0.1, discount: float = 0.9) -> Column:
    """The value of one state that leads to itself, updated by each reward."""
    return F.aggregate(rewards, F.lit(0.0), lambda q, r: q + rate * (r + discount * q - q))


def logistic_exponent(r: Column, x0: float, steps: int, discard: int) -> Column:
    """Mean logarithm of the slope of r x (1 - x) along its orbit, after the first steps."""
    start = F.struct(F.lit(x0).alias("x"), F.lit(0.0).alias("sum"))

    def step(a: Column, i: Column) -> Column:
        slope = F.abs(r * (1 - 2 * a["x"]))
        return F.struct((r * a["x"] * (1 - a["x"])).alias("x"), (a["sum"] + F.when(i > discard, F.ln(F.greatest(slope, F.lit(1e-12)))).otherwise(0.0)).alias("sum"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step, lambda a: a["sum"] / (steps - discard))


def runge_kutta(rate: Column, y0: Column, step: float, steps: int) -> Column:
    """y' = rate y (1 - y) by the classical fourth-order method."""
    f = lambda y: rate * y * (1 - y)

    def advance(y: Column, _: Column) -> Column:
        k1 = f(y)
        k2 = f(y + step / 2 * k1)
        k3 = f(y + step / 2 * k2)
        return y + step / 6 * (k1 + 2 * k2 + 2 * k3 + f(y + step * k3))

    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), y0, advance)


def interpolated(points: DataFrame, by: str, x: str, y: str, at: float) -> DataFrame:
    """(by, value): Lagrange's polynomial through a group's points; a group's distinct places are few."""
    a, b = points.select(by, F.col(x).alias("xi"), F.col(y).alias("yi")), points.select(by, F.col(x).alias("xj"))
    terms = a.join(b, by).groupBy(by, "xi", "yi").agg(F.product(F.when(F.col("xi") != F.col("xj"), (F.lit(at) - F.col("xj")) / F.nullif(F.col("xi") - F.col("xj"), F.lit(0.0))).otherwise(1.0)).alias("basis"))
    return terms.groupBy(by).agg(F.sum(F.col("yi") * F.col("basis")).alias("value"))


def equilibrium(a: list[Column], b: list[Column]) -> dict[str, Column]:
    """Of a two-player game with payoffs [[0, 1], [2, 3]] for each: how many pure equilibria, and the mixed shares where they exist."""
    best = lambda p, i, j: p[i] >= p[j]
    pure = [(best(a, i, i ^ 2) & best(b, i, i ^ 1)).cast("int") for i in range(4)]
    share = lambda p, x, y: F.when(p[0] - p[1] - p[2] + p[3] != 0, (p[3] - p[x]) / F.nullif(p[0] - p[1] - p[2] + p[3], F.lit(0.0)))
    inside = lambda s: F.when((s >= 0) & (s <= 1), s)
    return {"pure": sum(pure[1:], pure[0]), "first_plays_first": inside(share(b, 2, 1)), "second_plays_first": inside(share(a, 1, 2))}


def hull(points: DataFrame, by: str, x: str, y: str) -> DataFrame:
    """(by, x, y, position): corners of each group's convex hull, counterclockwise from the leftmost.

    Only the ends of each column of equal x can be corners: they are aggregated first, and a group's columns meet in one task.
    """
    ends = points.groupBy(by, x).agg(F.min(y).alias("low"), F.max(y).alias("high"))

    def corners(pdf: pd.DataFrame) -> pd.DataFrame:
        found = convex_hull(np.unique(np.concatenate((pdf[[x, "low"]].to_numpy(float), pdf[[x, "high"]].to_numpy(float))), axis=0))
        return pd.DataFrame({by: pdf[by].iloc[0], "x": found[:, 0], "y": found[:, 1], "position": np.arange(1, len(found) + 1, dtype=np.int32)})

    return ends.groupBy(by).applyInPandas(corners, f"{by} {points.schema[by].dataType.simpleString()}, x double, y double, position int")


def convex_hull(points: np.ndarray) -> np.ndarray:
    """Corners of points sorted by x, then y: a lower and an upper chain."""
    if len(points) < 3:
        return points

    def chain(rows: np.ndarray) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        for p in rows:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out

    return np.array(chain(points)[:-1] + chain(points[::-1])[:-1])


def viterbi(observed: np.ndarray, start: np.ndarray, move: np.ndarray, emit: np.ndarray) -> tuple[np.ndarray, float]:
    """The likeliest hidden states of a sequence, and their log probability; ties to the smaller state."""
    with np.errstate(divide="ignore"):
        s, m, e = np.log(start), np.log(move), np.log(emit)
    score, back = s + e[:, observed[0]], []
    for o in observed[1:]:
        ways = score[:, None] + m
        back.append(ways.argmax(0))
        score = ways.max(0) + e[:, o]
    path = [int(score.argmax())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return np.array(path[::-1]), float(score.max())


def choice_knapsack(groups: list[list[tuple[float, int]]], budget: int) -> float:
    """The best value of exactly one (value, size) of each group within the budget; -inf if none fits."""
    best = np.full(budget + 1, -np.inf)
    best[0] = 0.0
    for options in groups:
        now = np.full(budget + 1, -np.inf)
        for value, size in options:
            if size <= budget:
                now[size:] = np.maximum(now[size:], best[: budget + 1 - size] + value)
        best = now
    return float(best.max())


def priced_knapsack(value: np.ndarray, size: np.ndarray, budget: int, rounds: int = 50) -> np.ndarray:
    """Items worth more than a price on size that is moved until the choice fits, then filled up by value per size."""
    price, step, chosen = 0.0, float(np.max(value / size)) if len(value) else 0.0, np.zeros(len(value), bool)
    for i in range(rounds):
        chosen = value > price * size
        price = max(0.0, price + step / (i + 1) * (1 if size[chosen].sum() > budget else -1))
    order = np.argsort(-value / size, kind="stable") if len(value) else []
    taken = np.zeros(len(value), bool)
    for first in (True, False):
        for i in order:
            if chosen[i] == first and not taken[i] and size[taken].sum() + size[i] <= budget:
                taken[i] = True
    return np.flatnonzero(taken)


def shapley(players: list[str], worth) -> dict[str, float]:
    """Mean marginal worth over all orders of a few players."""
    out = dict.fromkeys(players, 0.0)
    orders = list(permutations(players))
    for order in orders:
        for i, p in enumerate(order):
            out[p] += (worth(frozenset(order[: i + 1])) - worth(frozenset(order[:i]))) / len(orders)
    return out


def heat(weights: np.ndarray, signal: np.ndarray, time: float) -> np.ndarray:
    """A signal diffused over a symmetric weighted graph: exp(-t L) f by the Laplacian's eigenvectors."""
    values, vectors = np.linalg.eigh(np.diag(weights.sum(1)) - weights)
    return vectors @ (np.exp(-time * values) * (vectors.T @ signal))


def periodicity(signal: np.ndarray, share: float = 0.1) -> tuple[float, list[int]]:
    """Share of power in the strongest tenth of frequencies, and frequencies stronger than mean + deviation."""
    power = np.abs(np.fft.rfft(signal - signal.mean())[1:]) ** 2
    if not len(power) or not power.sum():
        return 0.0, []
    k = max(1, int(len(power) * share))
    strong = np.flatnonzero(power > power.mean() + power.std()) + 1
    return float(np.sort(power)[-k:].sum() / power.sum()), strong.tolist()


def equality_minimum(q: np.ndarray, c: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """x of least x'Qx/2 + c'x under Ax = b, and the multipliers."""
    n, m = len(c), len(b)
    system = np.block([[q, a.T], [a, np.zeros((m, m))]])
    both = np.linalg.solve(system, np.concatenate((-c, b)))
    return both[:n], both[n:]


def cholesky(df: DataFrame, columns: list[str]) -> DataFrame:
    """(row, col, value): the lower factor of the columns' Gram matrix, from one aggregate of its entries; its transpose is R of a QR."""
    n = len(columns)
    sums = df.agg(*(F.sum(F.col(a) * F.col(b)).alias(f"g{i}_{j}") for i, a in enumerate(columns) for j, b in enumerate(columns) if j <= i))
    low: dict[tuple[int, int], Column] = {}
    for j in range(n):
        for i in range(j, n):
            rest = F.col(f"g{i}_{j}") - reduce(lambda x, y: x + y, (low[i, k] * low[j, k] for k in range(j)), F.lit(0.0))
            low[i, j] = F.sqrt(F.greatest(rest, F.lit(0.0))) if i == j else F.try_divide(rest, low[j, j])
    rows = [F.struct(F.lit(i).alias("row"), F.lit(j).alias("col"), v.alias("value")) for (i, j), v in low.items()]
    return sums.select(F.explode(F.array(*rows)).alias("r")).select("r.*")
