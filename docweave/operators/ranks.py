"""Ranks over a whole table without a single-task window: rows are sorted by ranges, and each partition's offset is added."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructType

from docweave.operators.graphs import written


def below(df: DataFrame, value: str, weight: str | None = None) -> DataFrame:
    """(value, n, below): for each distinct value, its rows (or their weights in sum) and those of strictly lower values.

    Counts are pre-aggregated, sorted by ranges and summed within partitions; the driver sees one total for each partition.
    """
    counts = df.groupBy(value).agg((F.sum(weight) if weight else F.count("*")).alias("n"))
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = counts.repartitionByRange(n, value).sortWithinPartitions(value)

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = TaskContext.get().partitionId(), 0
        for b in batches:
            rows = b.column(1).to_numpy()
            sums = rows.cumsum()
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(sums - rows + held), pa.array([part] * len(rows), pa.int32())], [*b.schema.names, "below", "part"])
            held += int(sums[-1]) if len(rows) else 0

    schema = StructType([*spread.schema.fields]).add("below", LongType()).add("part", IntegerType())
    summed = written(spread.mapInArrow(add_up, schema), "ranks")
    totals = {r.part: r.total for r in summed.groupBy("part").agg(F.max(F.col("below") + F.col("n")).alias("total")).collect()}
    offsets, held = [], 0
    for part in sorted(totals):
        offsets.append((part, held))
        held += totals[part]
    shift = df.sparkSession.createDataFrame(offsets, "part int, shift long")
    return summed.join(F.broadcast(shift), "part").select(value, "n", (F.col("below") + F.col("shift")).alias("below"))


def with_below(df: DataFrame, value: str) -> DataFrame:
    """The rows, with ``below``: how many rows have a strictly lower value."""
    return df.join(below(df, value).select(value, "below"), value)
