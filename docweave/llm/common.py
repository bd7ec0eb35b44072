"""Helpers shared by the operators: reading tables, cutting lineage, and walking Arrow batches in small steps."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that Python turns into objects at once; bounds a worker's memory when texts are long.
STEP_ROWS = 256
#: A step also ends once its strings hold this many bytes.
STEP_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; one of this machine only where that is unset on a local master."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="docweave-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: later jobs neither recompute nor lose it with an executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    # results are lazy and may read it until the application ends; then it goes
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


def aside(docs: DataFrame, keep: list[str], own: Iterable[str]) -> tuple[list[Column], list[str]]:
    """Columns to carry through an operator under names that meet none of its own (``_c0``, ``_c1``, ...), and their names.

    A kept column that is named as one of the operator's ``own`` gives way to it.
    """
    taken = {c.lower() for c in own}
    names = [c for c in keep if c.lower() not in taken]
    quoted = ["`" + c.replace("`", "``") + "`" for c in names]
    return [docs[c].alias(f"_c{i}") for i, c in enumerate(quoted)], names


def steps(batches: Iterable[pa.RecordBatch], sized_by: str, rows: int = STEP_ROWS, size: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each part has at most ``rows`` rows and, beyond its first row, ``size`` bytes in ``sized_by``."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(sized_by))
        start, held = 0, 0
        lengths = [len(x) if (x := v.as_buffer()) is not None else 0 for v in column]
        for i, n in enumerate(lengths):
            if i > start and (i - start >= rows or held + n > size):
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        if start < len(lengths):
            yield batch.slice(start)


def per_step(f: Callable[[pa.RecordBatch], pa.RecordBatch | None], sized_by: str, size: int = STEP_BYTES) -> Callable:
    """A ``mapInArrow`` function that applies ``f`` to small parts of each batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in steps(batches, sized_by, size=size):
            if (out := f(part)) is not None and out.num_rows:
                yield out

    return run


def bucket(doc_id: str = "doc_id", of: int = 5) -> Column:
    """crc32(doc_id as text) mod ``of``; a null id counts as the text "null"."""
    return (F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("null")).cast("binary")) % of).cast("int")


def share_of(*columns) -> Column:
    """An even number in [0, 1) from a row's values: under x for a share x of distinct values."""
    return F.shiftrightunsigned(F.xxhash64(*columns), 11) / F.lit(float(1 << 53))


def fold_of(doc_id: int | None, of: int) -> int:
    """``bucket`` in Python."""
    import zlib

    return zlib.crc32(("null" if doc_id is None else str(doc_id)).encode()) % of
