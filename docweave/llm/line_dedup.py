r"""Line dedup that can be undone: sharded cuckoo filters backed by exact reference counts.

A line's key is the line without blanks (``[\x20\x09-\x0D]``) at its ends, A-Z in lower case.  A key of at least ``LEAST`` code
points that stands in two documents or more loses its lines in all of them but the one of smallest id.

``LineIndex`` holds, in tables of the shared folder:

- *references*: (key, doc_id, lines).  Inserting documents appends their lines, deleting documents appends the same rows with
  negative counts; a document holds a key while its sum is positive.  The log is folded after ``FOLD`` changes.
- *counts*: (key, lines, least): of each key that recurs, the exact number of lines that hold it and the smallest of their documents.
- *filters*: a cuckoo filter for each shard of the keys, of the keys in *counts*.  A change computes the counts of the keys that it touches
  from the references, and inserts into and deletes from the filters just the keys that began or ceased to recur.  A shard that
  fills up is built anew from the counts; shards are doubled when they hold over ``SHARD_KEYS`` keys each on average.

``dedup`` holds the references of the given documents against the filters: lines that meet none are unique and go no further.  The
few others are joined with the exact counts, which removes false hits, and what a document loses returns to its text.  Filters
are sent to all tasks while they have at most ``MAX_FILTER_BYTES``; beyond, all references are joined with the counts, which
gives the same rows.  Keys are 128-bit BLAKE2 digests.  Keys that over one in ``HOT_SHARE`` of all references hold (at most ``HOT_SHARE``
of them) are joined by broadcast, so no key, however common, meets in one task; counts are pre-aggregated in every task.

Edge cases: a null or empty text is one empty line.  A row with a null id loses nothing and takes nothing from others.  Rows that
share an id are one document: they never take lines from one another, and deleting the id deletes all of them.  An id is
expected to be shared by few rows: what one document loses is one row.  A line repeated
within the document of smallest id stays as often as it stands there.  Inserting a document twice counts it twice; it must be
deleted once, which removes all its references.  Deleting unknown ids changes nothing.  Extra columns are kept by ``dedup`` unless
they are named as its own; the text gives way to ``kept``.  Texts of any length are handled whole; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.llm.common import aside, materialize, per_step
from docweave.llm.cuckoo import Filter

#: Code points of a key that counts.
LEAST = 10
SHARDS = 64
SHARD_KEYS = 1 << 18
MAX_FILTER_BYTES = 48 << 20
#: Changes after which the log of references is folded into one table.
FOLD = 8
HOT_SHARE = 100_000
BLANKS = b" \t\n\x0b\x0c\r"
_KEY = "key binary"


def line_keys(text: bytes | None, least: int = LEAST) -> list[bytes | None]:
    """The key's digest of each line; None for lines too short to count."""
    out: list[bytes | None] = []
    for line in (text or b"").split(b"\n"):
        key = line.strip(BLANKS)
        # a code point has one to four bytes
        if len(key) < least or (len(key) < 4 * least and not key.isascii() and len(key.decode("utf-8", "replace")) < least):
            out.append(None)
        else:
            out.append(hashlib.blake2b(key.lower(), digest_size=16).digest())
    return out


def halves(keys: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(b"".join(keys.to_pylist()), "<u8").reshape(-1, 2)
    return both[:, 0], both[:, 1]


def references_of(docs: DataFrame, least: int = LEAST, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(key, doc_id, lines): how many lines of a row hold each key."""
    id_type = docs.select(id_column).schema[0].dataType.simpleString()

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        keys, rows, counts = [], [], []
        for i, text in enumerate(b.column(1).cast(pa.binary()).to_pylist()):
            held: dict[bytes, int] = {}
            for key in line_keys(text, least):
                if key is not None:
                    held[key] = held.get(key, 0) + 1
            keys += held
            counts += held.values()
            rows += [i] * len(held)
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), b.column(0).take(pa.array(rows, pa.int64())), pa.array(counts, pa.int64())], ["key", "doc_id", "lines"])

    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text")).where("doc_id IS NOT NULL AND text IS NOT NULL")
    return rows.mapInArrow(per_step(run, "text"), f"{_KEY}, doc_id {id_type}, lines long")


def shard_of(shards: int):
    """By a byte pair that the filters do not use for buckets."""
    return F.pmod(F.conv(F.hex(F.substring("key", 13, 4)), 16, 10).cast("long"), F.lit(shards)).cast("int")


class LineIndex:
    """An index of documents' lines; ``insert``, ``delete`` and ``dedup`` in any order."""

    def __init__(self, spark: SparkSession, least: int = LEAST, id_type: str = "bigint"):
        self.spark, self.least, self.id_type = spark, least, id_type
        self.log: list[DataFrame] = []
        self.counts = spark.createDataFrame([], f"{_KEY}, lines long, least {id_type}")
        self.filters = spark.createDataFrame([], "shard int, filter binary")
        self.shards, self.recurring = SHARDS, 0

    # --- changes

    def insert(self, docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> None:
        more = materialize(references_of(docs, self.least, id_column, text_column), "references")
        self._change(more)

    def delete(self, ids: DataFrame, id_column: str = "doc_id") -> None:
        """ids: one column of the documents to forget."""
        gone = ids.select(F.col(id_column).cast(self.id_type).alias("doc_id")).where("doc_id IS NOT NULL").distinct()
        held = self.references().join(gone, "doc_id", "left_semi")
        self._change(materialize(held.select("key", "doc_id", (-F.col("lines")).alias("lines")), "references"))

    def references(self) -> DataFrame:
        """(key, doc_id, lines) of the documents that are in the index; the log's opposite rows cancel."""
        if not self.log:
            return self.spark.createDataFrame([], f"{_KEY}, doc_id {self.id_type}, lines long")
        if len(self.log) == 1:
            return self.log[0]
        every = self.log[0]
        for part in self.log[1:]:
            every = every.unionByName(part)
        return every.groupBy("key", "doc_id").agg(F.sum("lines").alias("lines")).where("lines > 0")

    def _change(self, part: DataFrame) -> None:
        first = not self.log
        self.log.append(part)
        if len(self.log) > FOLD:
            self.log = [materialize(self.references(), "references")]
        if first:
            self.counts = materialize(recurring(part), "counts")
            self._build()
            return
        touched = part.select("key").distinct()
        now = materialize(recurring(self.references().join(touched, "key", "left_semi")), "touched")
        before = self.counts.join(touched, "key", "left_semi").select("key")
        began, ceased = now.select("key").join(before, "key", "left_anti"), before.join(now.select("key"), "key", "left_anti")
        changed = materialize(began.withColumn("sign", F.lit(1)).unionByName(ceased.withColumn("sign", F.lit(-1))), "changed")
        self.counts = materialize(self.counts.join(touched, "key", "left_anti").unionByName(now), "counts")
        self._update(changed)

    # --- filters

    def _build(self) -> None:
        """Filters of all keys that recur, from the exact counts."""
        self.recurring = self.counts.count()
        while self.recurring > self.shards * SHARD_KEYS:
            self.shards *= 2

        def build(keys: pd.DataFrame) -> pd.DataFrame:
            out = Filter(len(keys))
            out.insert(*halves(pa.array(keys["key"], pa.binary())))
            return pd.DataFrame({"shard": keys["shard"].iloc[:1], "filter": [out.to_bytes()]})

        keyed = self.counts.select("key", shard_of(self.shards).alias("shard"))
        self.filters = materialize(keyed.groupBy("shard").applyInPandas(build, "shard int, filter binary"), "filters")

    def _update(self, changed: DataFrame) -> None:
        """changed: (key, sign), 1 for keys that began and -1 for keys that ceased to recur."""
        self.recurring = self.counts.count()
        if self.recurring > self.shards * SHARD_KEYS:
            self._build()
            return

        def update(key: tuple, held: pd.DataFrame, keys: pd.DataFrame) -> pd.DataFrame:
            now = Filter.from_bytes(held["filter"].iloc[0]) if len(held) else Filter(len(keys))
            for sign, change in ((-1, now.delete), (1, now.insert)):
                some = keys["key"][keys["sign"] == sign]
                if len(some):
                    change(*halves(pa.array(some, pa.binary())))
            return pd.DataFrame({"shard": [key[0]], "filter": [now.to_bytes()], "full": [now.full]})

        keyed = changed.withColumn("shard", shard_of(self.shards))
        out = materialize(self.filters.groupBy("shard").cogroup(keyed.groupBy("shard")).applyInPandas(update, "shard int, filter binary, full boolean"), "filters")
        if out.where("full").isEmpty():
            self.filters = out.select("shard", "filter")
        else:
            self._build()

    # --- use

    def candidates(self, refs: DataFrame) -> DataFrame:
        """The references (key, doc_id) that meet a filter: all that recur, and few others."""
        refs = refs.select("key", "doc_id")
        size = self.filters.agg(F.coalesce(F.sum(F.length("filter")), F.lit(0)).alias("n")).first().n
        if size > MAX_FILTER_BYTES:
            return refs
        shards = self.shards
        # at most MAX_FILTER_BYTES in all
        shared = self.spark.sparkContext.broadcast({r.shard: bytes(r.filter) for r in self.filters.collect()})

        def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            filters = {s: Filter.from_bytes(f) for s, f in shared.value.items()}
            for b in batches:
                if not b.num_rows:
                    continue
                high, low = halves(b.column(0))
                # bytes 13 to 16 of a key, read as one number with the first byte highest
                at = (low >> np.uint64(32)).astype(np.uint32).byteswap() % np.uint32(shards)
                hit = np.zeros(len(high), dtype=bool)
                order = np.argsort(at, kind="stable")
                for rows in np.split(order, np.flatnonzero(np.diff(at[order])) + 1):
                    if (f := filters.get(int(at[rows[0]]))) is not None:
                        hit[rows] = f.contains(high[rows], low[rows])
                yield b.filter(pa.array(hit))

        return refs.mapInArrow(probe, refs.schema)

    def losses(self, refs: DataFrame) -> DataFrame:
        """(doc_id, keys): the keys whose lines a document loses."""
        found = self.candidates(refs)
        total = self.counts.agg(F.coalesce(F.sum("lines"), F.lit(0)).alias("n")).first().n
        hot = F.col("lines") > F.lit(max(total // HOT_SHARE, 10_000))
        exact = self.counts.select("key", "least", "lines")
        # at most HOT_SHARE keys, and none of fewer than 10,000 lines
        common = F.broadcast(exact.where(hot).select("key", "least"))
        by_common = found.join(common.withColumnRenamed("least", "common_least"), "key", "left")
        settled = by_common.where("common_least IS NOT NULL AND doc_id > common_least").select("doc_id", "key")
        rest = by_common.where("common_least IS NULL").drop("common_least")
        others = rest.join(exact.where(~hot).select("key", "least"), "key").where("doc_id > least").select("doc_id", "key")
        return settled.unionByName(others).groupBy("doc_id").agg(F.collect_set("key").alias("keys"))

    def dedup(self, docs: DataFrame, refs: DataFrame | None = None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
        """``docs``, which are in the index, with (n_lines, n_dropped, kept) instead of their text.

        refs: the documents' references where these are at hand, as right after their insertion.
        """
        least = self.least
        refs = references_of(docs, least, id_column, text_column) if refs is None else refs
        carried, names = aside(docs, [c for c in docs.columns if c != text_column], ["n_lines", "n_dropped", "kept"])
        text, own = F.col(text_column), F.col(id_column)
        # rows without an id meet nothing; they are spread by their texts
        rows = docs.select(*carried, text.alias("_text"), own.isNull().alias("_none"), F.coalesce(own.cast("string"), F.xxhash64(text).cast("string")).alias("_at"))
        lost = self.losses(refs).select(F.lit(False).alias("_none"), F.col("doc_id").cast("string").alias("_at"), F.col("keys").alias("_keys"))
        joined = rows.join(lost, ["_none", "_at"], "left").drop("_none", "_at")
        n = len(names)

        def remove(b: pa.RecordBatch) -> pa.RecordBatch:
            n_lines, n_dropped, kept = [], [], []
            for text, keys in zip(b.column(n).cast(pa.binary()).to_pylist(), b.column(n + 1).to_pylist()):
                text = text or b""
                total, stay = text.count(b"\n") + 1, text
                lines = total
                if keys:
                    gone = set(keys)
                    left = [line for line, key in zip(text.split(b"\n"), line_keys(text, least)) if key not in gone]
                    stay, lines = b"\n".join(left), len(left)
                n_lines.append(total)
                n_dropped.append(total - lines)
                kept.append(stay)
            columns = [pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())]
            return pa.RecordBatch.from_arrays([*b.columns[:n], *columns], [*(f"_c{i}" for i in range(n)), "n_lines", "n_dropped", "kept"])

        types = [docs.schema[c].dataType.simpleString() for c in names]
        schema = ", ".join([*(f"_c{i} {t}" for i, t in enumerate(types)), "n_lines long, n_dropped long, kept string"])
        out = joined.mapInArrow(per_step(remove, "_text"), schema)
        return out.select(*(F.col(f"_c{i}").alias(c) for i, c in enumerate(names)), "n_lines", "n_dropped", "kept")


def recurring(refs: DataFrame) -> DataFrame:
    """(key, lines, least) of the keys that at least two documents hold; pre-aggregated in every task."""
    held = refs.groupBy("key").agg(F.sum("lines").alias("lines"), F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))
    return held.where("least != most").select("key", "lines", "least")


def dedup_lines(docs: DataFrame, least: int = LEAST, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """All documents against one another: an index of them, then what each keeps."""
    id_type = docs.select(id_column).schema[0].dataType.simpleString()
    index = LineIndex(docs.sparkSession, least, id_type)
    index.insert(docs, id_column, text_column)
    return index.dedup(docs, index.log[0], id_column, text_column)
