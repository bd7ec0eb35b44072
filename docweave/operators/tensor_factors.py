"""Factors of sparse tensors: CP by alternating least squares, Tucker by orthogonal iteration.

A tensor is a table of entries, a column for each mode's coordinates and ``value``; a factor is a dense table (id, v) with a row for
each coordinate.  Entries are joined with the other modes' factors and summed by coordinate, in every task first, so a tensor is never laid out;
what the driver holds is as wide as the ranks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import prod

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.operators.factors import BROADCAST_NUMBERS, dense_svd, matrices, orthonormal, signs
from docweave.operators.graphs import written

#: Columns of a product of factors: expressions of one aggregation.
MAX_COLUMNS = 512


@dataclass(frozen=True)
class Cp:
    """A factor for each mode, weights one; the relative error of the reconstruction, and the share of the squares that it explains."""

    factors: list[DataFrame]
    error: float
    explained: float
    rounds: int
    converged: bool


@dataclass(frozen=True)
class Tucker:
    """Orthonormal factors, the core as an array, error and explained share as above."""

    factors: list[DataFrame]
    core: np.ndarray
    error: float
    explained: float
    rounds: int
    converged: bool


def contracted(entries: DataFrame, modes: list[str], factors: list[DataFrame], widths: list[int], skip: int, outer: bool) -> DataFrame:
    """(id, v) for each coordinate of mode ``skip``: the sum over its entries of the value times the other factors' rows, entry by
    entry (all of one width) or, ``outer``, each with each, the last mode's varying fastest."""
    others = [m for m in range(len(modes)) if m != skip]
    columns = prod(widths[m] for m in others) if outer else widths[others[0]]
    if columns > MAX_COLUMNS:
        raise ValueError(f"{columns} columns; at most {MAX_COLUMNS} are summed at once")
    joined = entries
    for m in others:
        side = factors[m].select(F.col("id").alias(modes[m]), F.col("v").alias(f"_v{m}"))
        if factors[m].count() * widths[m] <= BROADCAST_NUMBERS:
            side = F.broadcast(side)
        joined = joined.join(side, modes[m])
    sums = []
    for j in range(columns):
        term, rest = F.col("value"), j
        for m in reversed(others):
            at = rest % widths[m] if outer else j
            rest //= widths[m] if outer else 1
            term = term * F.col(f"_v{m}")[at]
        sums.append(F.sum(term).alias(f"s{j}"))
    out = joined.groupBy(F.col(modes[skip]).alias("id")).agg(*sums)
    return out.select("id", F.array(*(F.col(f"s{j}") for j in range(columns))).cast("array<double>").alias("v"))


def gram(dense: DataFrame, width: int) -> np.ndarray:
    cells = [(a, b) for a in range(width) for b in range(a, width)]
    row = dense.agg(*(F.coalesce(F.sum(F.col("v")[a] * F.col("v")[b]), F.lit(0.0)).alias(f"g{a}_{b}") for a, b in cells)).first()
    out = np.zeros((width, width))
    for (a, b), v in zip(cells, row):
        out[a, b] = out[b, a] = v
    return out


def solved(right: DataFrame, inverse: np.ndarray, nonnegative: bool) -> DataFrame:
    """(id, v, met): each row times the inverse, and its product with the row it came from."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, m in matrices(batches, 1):
            v = m @ inverse
            v = np.maximum(v, 0.0) if nonnegative else v
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(list(v)), pa.array((v * m).sum(axis=1))], ["id", "v", "met"])

    return right.select("id", "v").mapInArrow(run, f"id {right.schema['id'].dataType.simpleString()}, v array<double>, met double")


def joined_entries(entries: DataFrame, modes: list[str]) -> tuple[DataFrame, float]:
    """Entries of one place added up, those without a coordinate left out; and the sum of squares."""
    e = entries.where(" AND ".join(f"`{m}` IS NOT NULL" for m in [*modes, "value"])).groupBy(*modes).agg(F.sum("value").cast("double").alias("value")).where("value != 0")
    e = written(e, "tensor")
    return e, float(e.agg(F.coalesce(F.sum(F.col("value") * F.col("value")), F.lit(0.0))).first()[0])


def cp(entries: DataFrame, modes: list[str], rank: int, rounds: int = 50, tolerance: float = 1e-6, seed: int = 7, nonnegative: bool = True) -> Cp:
    """Rank-one parts whose sum is near the tensor.  Each mode's factor is solved in turn from normal equations of the rank's size, negative entries
    set to zero if asked, until the error moves by less than ``tolerance``.  A tensor without entries has empty factors and no error."""
    e, squares = joined_entries(entries, modes)

    def even(n: int) -> DataFrame:
        """A start in [0, 1) that depends on the coordinate alone."""
        parts = [F.shiftrightunsigned(F.xxhash64("id", F.lit(seed + n), F.lit(r)), 11) / float(1 << 53) for r in range(rank)]
        return written(e.select(F.col(modes[n]).alias("id")).distinct().select("id", F.array(*parts).alias("v")), "factor")

    factors = [even(n) for n in range(len(modes))]
    if not squares:
        return Cp(factors, 0.0, 1.0, 0, True)
    grams = [gram(f, rank) for f in factors]
    last, error, converged, took = np.inf, 1.0, False, 0
    for took in range(1, rounds + 1):
        for n in range(len(modes)):
            normal = np.prod([g for m, g in enumerate(grams) if m != n], axis=0)
            found = written(solved(contracted(e, modes, factors, [rank] * len(modes), n, outer=False), np.linalg.pinv(normal), nonnegative), "factor")
            factors[n] = found.select("id", "v")
            grams[n] = gram(factors[n], rank)
        met = float(found.agg(F.sum("met")).first()[0])
        error = float(np.sqrt(max(0.0, squares - 2 * met + np.prod(grams, axis=0).sum()) / squares))
        if abs(last - error) < tolerance:
            converged = True
            break
        last = error
    return Cp(factors, error, max(0.0, 1 - error**2), took, converged)


def tucker(entries: DataFrame, modes: list[str], ranks: list[int], rounds: int = 50, tolerance: float = 1e-8, seed: int = 42) -> Tucker:
    """A core of ``ranks`` and an orthonormal factor for each mode: each is in turn the leading left vectors of the tensor contracted with the others.
    A mode whose rank is more than the tensor has there gets what it has."""
    if len(ranks) != len(modes) or min(ranks) < 1:
        raise ValueError("a rank of at least one for each mode")
    e, squares = joined_entries(entries, modes)
    factors, widths = [], []
    for n, r in enumerate(ranks):
        ids = e.select(F.col(modes[n]).alias("id")).distinct()
        q, _, width = orthonormal(written(ids.select("id", F.array(*signs(F.col("id"), r, seed + n)).alias("v")), "start"), r)
        factors.append(q)
        widths.append(width)
    if not squares:
        return Tucker(factors, np.zeros([0] * len(modes)), 0.0, 1.0, 0, True)
    last, error, converged, took, core = np.inf, 1.0, False, 0, np.zeros(0)
    for took in range(1, rounds + 1):
        for n in range(len(modes)):
            columns = prod(w for m, w in enumerate(widths) if m != n)
            svd = dense_svd(written(contracted(e, modes, factors, widths, n, outer=True), "contracted"), columns, ranks[n])
            factors[n], widths[n] = svd.left, len(svd.values)
        right = np.array([r.v for r in svd.right.orderBy("id").collect()])  # as wide as the other ranks' product
        core = np.moveaxis((right * svd.values).T.reshape(widths[-1], *widths[:-1]), 0, -1)
        error = float(np.sqrt(max(0.0, squares - (core**2).sum()) / squares))
        if abs(last - error) < tolerance:
            converged = True
            break
        last = error
    return Tucker(factors, core, error, max(0.0, 1 - error**2), took, converged)
