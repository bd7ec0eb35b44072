"""Embedding whitening by a compensated covariance.

Vectors are fixed-point numbers x = floor(scale * c).  Means and covariance are taken over the *fit list*, each distinct x once,
in passes whose tasks return one matrix each, whatever their number of rows:

1. Sums of x, exact, as two halves of each number.
2. Outer products of x - mean.  The mean is a quotient that no double holds, so centred entries are double-double (two
   doubles, high and low).  Each block of rows is cut, without error, into ``SLICES`` matrices of few enough bits that the matrix
   product of any two of them is exact in doubles; these products are added up as double-double by an error-free
   transformation (two-sum).  Tasks' high and low parts are merged the same way, in two steps of Spark groups.
3. The covariance goes to the driver (dimensions squared, whatever the rows), where LAPACK's ``syevd`` brings it to tridiagonal form and
   solves that by divide and conquer.
4. Whitened rows' own mean and covariance are measured in two more compensated passes; their distance from the identity is
   returned with the rows.

Edge cases: a vector that is null, empty, or holds null, NaN, infinite or |scale * c| >= 2**62 takes no part, nor does one whose length
differs from the commonest (of equally common ones the longer counts).  Rows with null or repeated ids each return.  An empty
table gives an empty result.  Fewer dimensions than components give fewer components.  A component without variance (fewer
distinct vectors than components, constant dimensions) has ``whitened`` and ``explained`` 0 and does not count in the identity's
error.  Each eigenvector's entry of largest size is positive, so signs are the same for all rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.llm.common import materialize

SCALE = 256
COMPONENTS = 4
#: Rows of a block and bits of a slice: products of two slices' entries, summed over a block, stay under 2**53.
BLOCK = 1024
SLICE_BITS = 21
SLICES = 4
#: Tasks' matrices are first merged in so many groups for each of their rows.
MERGE = 32
#: The driver and every task hold matrices of this many dimensions squared.
MAX_DIMENSIONS = 4096
_HALF = 31


def two_sum(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """a + b as the rounded sum and its exact error."""
    s = a + b
    back = s - a
    return s, (a - (s - back)) + (b - back)


def add(high: np.ndarray, low: np.ndarray, more: np.ndarray, more_low: np.ndarray | float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """The sum of two double-double numbers."""
    s, e = two_sum(high, more)
    t, f = two_sum(low, np.broadcast_to(more_low, low.shape))
    s, e = two_sum(s, e + t)
    return two_sum(s, e + f)


def pair(value: Fraction) -> tuple[float, float]:
    """A number as double-double."""
    high = float(value)
    return high, float(value - Fraction(high))


def centred(x: np.ndarray, mean: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """x (integers) less the mean (2 x dimensions: high and low parts), as double-double."""
    near = x.astype(np.float64)
    rest = (x - near.astype(np.int64)).astype(np.float64)
    return add(near, rest, -mean[0], -mean[1])


def slices(high: np.ndarray, low: np.ndarray) -> list[np.ndarray]:
    """Matrices that add up to high + low but for what lies SLICES * SLICE_BITS below the largest entry of a column: each entry is
    a multiple of its column's unit, at most 2**(SLICE_BITS - 1) times it."""
    top = np.abs(high).max(axis=0)
    unit = np.ldexp(1.0, np.frexp(np.where(top > 0, top, 1.0))[1] - (SLICE_BITS - 1))
    out = []
    for _ in range(SLICES):
        part = np.rint(high / unit) * unit
        out.append(part)
        high, low = two_sum(high - part, low)
        unit = np.ldexp(unit, -SLICE_BITS)
    return out


class OuterProducts:
    """Double-double sum of the outer products of rows."""

    def __init__(self, size: int):
        self.high, self.low = np.zeros((size, size)), np.zeros((size, size))

    def update(self, high: np.ndarray, low: np.ndarray) -> None:
        """Rows as double-double, BLOCK of them at most."""
        parts = slices(high, low)
        for order in range(2 * SLICES - 2, -1, -1):  # small products first; orders beyond SLICES are below all that is kept
            for i in range(max(0, order - SLICES + 1), min(order, SLICES - 1) + 1):
                if order <= SLICES:
                    self.high, self.low = add(self.high, self.low, parts[i].T @ parts[order - i])


def blocks(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[np.ndarray]:
    """The vectors of a list column as matrices of at most BLOCK rows."""
    for b in batches:
        if b.num_rows:
            values = b.column(b.schema.get_field_index(column))
            m = np.asarray(values.flatten()).reshape(b.num_rows, -1)
            for i in range(0, len(m), BLOCK):
                yield m[i : i + BLOCK]


def fixed_point(vectors: DataFrame, id_column: str, vector_column: str, scale: int) -> DataFrame:
    """(vec_id, x array<long>) of the rows that take part."""
    c = F.col(vector_column).cast("array<double>")
    usable = F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v * F.lit(float(scale))) < F.lit(float(1 << 62))))
    rows = vectors.select(F.col(id_column).alias("vec_id"), c.alias("c")).where(F.col("c").isNotNull() & (F.size("c") > 0) & usable)
    size = rows.groupBy(F.size("c").alias("n")).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), F.desc("n")).first()
    if size and size.n > MAX_DIMENSIONS:
        raise ValueError(f"vectors of {size.n} dimensions; at most {MAX_DIMENSIONS} are whitened")
    return rows.where(F.size("c") == (size.n if size else 0)).select("vec_id", F.transform("c", lambda v: F.floor(v * F.lit(float(scale))).cast("long")).alias("x"))


def exact_sums(fit: DataFrame) -> tuple[int, list[int]]:
    """Rows and each dimension's sum, without rounding at any size."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, upper, lower = 0, 0, 0
        for x in blocks(batches, "x"):
            n, upper, lower = n + len(x), upper + (x >> _HALF).sum(axis=0), lower + (x & ((1 << _HALF) - 1)).sum(axis=0)
        if n:
            size = len(upper)
            yield pa.RecordBatch.from_arrays([pa.array(range(size), pa.int32()), pa.array(upper), pa.array(lower), pa.array([n] * size, pa.int64())], ["i", "upper", "lower", "n"])

    wide = {c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("upper", "lower", "n")}
    rows = fit.select("x").mapInArrow(part, "i int, upper long, lower long, n long").groupBy("i").agg(*wide.values()).orderBy("i").collect()  # one for each dimension
    return (int(rows[0].n) if rows else 0), [(int(r.upper) << _HALF) + int(r.lower) for r in rows]


def merged(parts: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The double-double sum of all tasks' matrices; parts: (i, task, high array<double>, low array<double>), a row for each matrix row."""

    def fold(batches: list) -> tuple[np.ndarray, np.ndarray]:
        high, low = np.zeros(size), np.zeros(size)
        for h, m in batches:
            high, low = add(high, low, np.asarray(h), np.asarray(m))
        return high, low

    def merge(keys: list[str]) -> Callable:
        import pandas as pd

        def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
            high, low = fold(zip(group["high"], group["low"]))
            return pd.DataFrame({**{k: [v] for k, v in zip(keys, key)}, "high": [high], "low": [low]})

        return run

    once = parts.groupBy("i", "part").applyInPandas(merge(["i", "part"]), "i int, part int, high array<double>, low array<double>")
    twice = once.groupBy("i").applyInPandas(merge(["i"]), "i int, high array<double>, low array<double>")
    high, low = np.zeros((size, size)), np.zeros((size, size))
    for r in twice.collect():  # size rows
        high[r.i], low[r.i] = r.high, r.low
    return high, low


def outer_products(rows: DataFrame, column: str, size: int, centre: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """The double-double sum of the outer products of ``centre`` of all rows."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        total, n, mark = OuterProducts(size), 0, 0
        for x in blocks(batches, column):
            total.update(*centre(x))
            n, mark = n + len(x), zlib.crc32(np.ascontiguousarray(x).view(np.uint8), mark)
        if n:
            # the group of a task's matrix follows from its rows, so a repeated task gives the same
            names = ["i", "part", "high", "low"]
            yield pa.RecordBatch.from_arrays([pa.array(range(size), pa.int32()), pa.array([mark % MERGE] * size, pa.int32()), pa.array(list(total.high)), pa.array(list(total.low))], names)

    return merged(rows.select(column).mapInArrow(part, "i int, part int, high array<double>, low array<double>"), size)


@dataclass(frozen=True)
class Model:
    """What whitening needs: the fit list's size and sums, its mean as double-double, and the components with their variances."""

    n: int
    sums: list[int]
    mean: np.ndarray
    vectors: np.ndarray
    variances: np.ndarray
    explained: np.ndarray

    def whiten(self, x: np.ndarray) -> np.ndarray:
        """Rows x components."""
        high, low = centred(x, self.mean)
        scale = np.where(self.variances > 0, 1 / np.sqrt(np.where(self.variances > 0, self.variances, 1.0)), 0.0)
        return (high @ self.vectors + low @ self.vectors) * scale


def eigenpairs(covariance: np.ndarray, components: int) -> tuple[np.ndarray, np.ndarray]:
    """Variances, falling, and unit vectors as columns; variances that rounding cannot tell from none are 0."""
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    largest = np.abs(vectors).argmax(axis=0)
    vectors = vectors * np.where(vectors[largest, np.arange(vectors.shape[1])] < 0, -1.0, 1.0)
    floor = len(covariance) * np.finfo(np.float64).eps * max(values[0], 0.0)
    return np.where(values > floor, values, 0.0), vectors


def fit(rows: DataFrame, components: int = COMPONENTS) -> Model | None:
    """rows: each distinct ``x`` once; None if there are none."""
    n, sums = exact_sums(rows)
    if not n:
        return None
    mean = np.array([pair(Fraction(s, n)) for s in sums]).T
    high, low = outer_products(rows, "x", len(sums), lambda x: centred(x, mean))
    covariance = high / n + low / n
    covariance = (covariance + covariance.T) / 2
    variances, vectors = eigenpairs(covariance, components)
    trace = float(np.trace(covariance))
    return Model(n, sums, mean, vectors, variances, variances / trace if trace > 0 else np.zeros_like(variances))


def identity_error(rows: DataFrame, model: Model) -> float:
    """The largest absolute entry of the whitened fit list's covariance less the identity, over components that vary."""
    varying = np.flatnonzero(model.variances > 0)
    if not len(varying):
        return 0.0
    size = len(varying)

    def whiten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in blocks(batches, "x"):
            yield pa.RecordBatch.from_arrays([pa.array(list(model.whiten(x)[:, varying]))], ["w"])

    whitened = rows.select("x").mapInArrow(whiten, "w array<double>")
    ones = lambda w: (np.column_stack([np.ones(len(w)), w]), np.zeros((len(w), size + 1)))
    high, low = outer_products(whitened, "w", size + 1, ones)  # the first row holds the sums
    mean = np.array([pair((Fraction(h) + Fraction(m)) / model.n) for h, m in zip(high[0, 1:], low[0, 1:])]).T
    high, low = outer_products(whitened, "w", size, lambda w: add(w, np.zeros_like(w), -mean[0], -mean[1]))
    return float(np.abs((high + low) / model.n - np.eye(size)).max())


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int]:
    """For each row the sum over dimensions of (n * x - sum) squared, exact: in machine numbers while these can hold it."""
    reach = max(max((abs(int(v)) for v in (x.min(), x.max())), default=0) * n + max(map(abs, sums)), 1)
    kind = np.int64 if reach * reach * len(sums) < 1 << 62 else object
    d = x.astype(kind) * n - np.array(sums, dtype=kind)
    return [int(v) for v in (d * d).sum(axis=1)]


def whiten(vectors: DataFrame, components: int = COMPONENTS, scale: int = SCALE, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """(vec_id, component, n, deviation decimal(38,0), whitened, explained, identity_error): a row for each usable vector and component.

    ``deviation`` is exact; null where it needs over 38 digits.
    """
    from decimal import Decimal

    spark = vectors.sparkSession
    rows = fixed_point(vectors, id_column, vector_column, scale)
    id_type = rows.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {id_type}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    distinct = materialize(rows.select("x").distinct(), "fit-list")
    model = fit(distinct, components)
    if model is None:
        return spark.createDataFrame([], schema)
    shared, error, most = spark.sparkContext.broadcast(model), identity_error(distinct, model), 10**38

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        k = len(m.variances)
        for b in batches:
            for i in range(0, b.num_rows, BLOCK):
                part = b.slice(i, BLOCK)
                (x,) = blocks(iter([part]), "x")
                each = np.repeat(np.arange(len(x)), k)
                exact = [Decimal(d) if d < most else None for d in deviations(x, m.n, m.sums)]
                columns = [
                    part.column(0).take(pa.array(each)),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                    pa.array(np.full(len(each), m.n, dtype=np.int64)),
                    pa.array(exact, pa.decimal128(38, 0)).take(pa.array(each)),
                    pa.array(m.whiten(x).ravel()),
                    pa.array(np.tile(m.explained, len(x))),
                    pa.array(np.full(len(each), error)),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(project, schema)
