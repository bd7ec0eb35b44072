"""Sequence packing: best-fit decreasing over a segment tree indexed by remaining capacity.

Texts become token ids, as ``tokenizers`` gives them, plus one end id.  Documents longer than a window are cut into full windows and a tail, so a piece has
1 to ``size`` ids.  Best-fit decreasing needs only how many pieces have each length, at most ``size`` numbers whatever the
input: the driver lays out windows for these counts (open windows of equal capacity are handled as ranges), and each piece
finds its place by its rank among pieces of its length.  Ranks are counted in each task while pieces are written, and joined
with the tasks' running totals, so no length, however common, meets in one task.

With byte-level pre-tokens, none crosses a single space between two other characters, so a text is cut there, and ids of short
parts are remembered in each worker: the tokenizer sees a part once.  Parts are of any length, so texts are encoded whole.

Edge cases: a null or empty text is its end id alone.  Repeated rows are packed each.  An empty table gives no sequence.  Ids may
be of any type, and null.  Other columns are not read.
"""

from __future__ import annotations

import json
import re
import sys
import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from docweave.llm.common import materialize, steps

SIZE = 2048
END_ID = 1
#: Where a text may be cut without a change to its ids: before a space that stands alone between characters that are no spaces.
PART = re.compile(r"(?<=\S)(?= \S)")
#: A part of one word, with what follows the word: here too pre-tokens end.
WORD = re.compile(r"( ?[A-Za-zÀ-ÖØ-öø-ÿ]+)([!-/:-@\[-`{-~]*)")
#: Parts of up to this many characters are remembered, up to twice so many.
PART_CHARS, PARTS = 48, 400_000
_loaded: dict[str, Parts] = {}


class Parts(dict):
    """Ids of a text's parts, as little-endian 32-bit numbers.

    Once ``PARTS`` are held they become the older ones, and those before are forgotten; older parts that come again are kept.
    """

    def __init__(self, vocabulary: str):
        super().__init__()
        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.older: dict[str, bytes] = {}
        rules = json.loads(self.tokenizer.to_str())
        before = rules["pre_tokenizer"] or {}
        self.cut = not rules["normalizer"] and before.get("type") == "ByteLevel" and before["use_regex"] and not before["add_prefix_space"] and rules["model"]["type"] == "BPE"
        self.cut = self.cut and not any(re.search(r"\s", t["content"]) or t["lstrip"] or t["rstrip"] or t["single_word"] for t in rules["added_tokens"])
        self.added = [t["content"] for t in rules["added_tokens"]]
        # the pre-tokenizer writes each byte as one character: itself where that can be seen, those from 256 on for all others
        seen = {*range(33, 127), *range(161, 173), *range(174, 256)}
        unseen = [b for b in range(256) if b not in seen]
        self.written = {b: b if b in seen else 256 + unseen.index(b) for b in range(256)}

    def __missing__(self, part: str) -> bytes:
        ids = self.older.get(part)
        if ids is None:
            m = WORD.fullmatch(part)
            if m and not any(t in part for t in self.added):
                ids = self[m[1]] + self[m[2]] if m[2] else self.bytes_of([t.id for t in self.tokenizer.model.tokenize(part.encode().decode("latin-1").translate(self.written))])
            else:
                ids = self.bytes_of(self.tokenizer.encode(part, add_special_tokens=False).ids)
        if len(part) <= PART_CHARS:
            if len(self) >= PARTS:
                self.older = dict(self)
                self.clear()
            self[part] = ids
        return ids

    @staticmethod
    def bytes_of(ids: list[int]) -> bytes:
        return array("I", ids).tobytes() if sys.byteorder == "little" else np.array(ids, dtype="<u4").tobytes()

    def encode(self, text: str) -> bytes:
        if not self.cut:
            return self.bytes_of(self.tokenizer.encode(text, add_special_tokens=False).ids)
        return b"".join(map(self.__getitem__, PART.split(text))) if text else b""


def load(vocabulary: str) -> Parts:
    """The tokenizer of a file, read once in each worker."""
    if vocabulary not in _loaded:
        _loaded[vocabulary] = Parts(vocabulary)
    return _loaded[vocabulary]


class OpenWindows:
    """A segment tree over capacities 1..size; ``tightest(n)`` is the least capacity of at least n that has an open window."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.any = [False] * (2 * self.leaves)
        self.ranges: dict[int, list[tuple[int, int]]] = defaultdict(list)

    def mark(self, capacity: int) -> None:
        i = self.leaves + capacity
        self.any[i] = bool(self.ranges[capacity])
        while i > 1:
            i //= 2
            self.any[i] = self.any[2 * i] or self.any[2 * i + 1]

    def put(self, capacity: int, first: int, n: int) -> None:
        if capacity and n:
            self.ranges[capacity].append((first, n))
            self.mark(capacity)

    def take(self, capacity: int, most: int) -> tuple[int, int]:
        first, n = self.ranges[capacity].pop()
        if n > most:
            self.ranges[capacity].append((first + most, n - most))
            n = most
        self.mark(capacity)
        return first, n

    def tightest(self, least: int) -> int:
        """0 if there is none."""
        i = self.leaves + least
        while not self.any[i]:
            while i & 1:  # a right child: nothing further right under its parent
                i //= 2
            if not i:
                return 0
            i += 1
        while i < self.leaves:
            i = 2 * i if self.any[2 * i] else 2 * i + 1
        return i - self.leaves


def layout(counts: dict[int, int], size: int) -> np.ndarray:
    """Best-fit decreasing for counts of pieces by length.  Rows (length, first rank, n windows, pieces each, first window,
    first offset): pieces of that length with ranks from ``first rank`` go to these windows in turn, so many to each."""
    tree, rows, used = OpenWindows(size), [], 0
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            capacity = tree.tightest(length)
            if capacity:
                # a window that took one piece and has room for the next is now the tightest, so it is filled first
                each = min(capacity // length, left)
                first, n = tree.take(capacity, max(1, left // each))
            else:
                capacity, each = size, min(size // length, left)
                first, n = used, left // each
                used += n
            rows.append((length, rank, n, each, first, size - capacity))
            tree.put(capacity - each * length, first, n)
            rank += n * each
            left -= n * each
    return np.array(rows, dtype=np.int64).reshape(-1, 6)


def pieces_of(docs: DataFrame, id_column: str, text_column: str, vocabulary: str, size: int, end_id: int) -> DataFrame:
    """A row for each piece, with the task that made it and its number there among pieces of its length."""
    end = np.array([end_id], dtype="<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, task, seen = load(vocabulary), TaskContext.get().partitionId(), defaultdict(int)
        for b in steps(batches, "_text"):
            out = []
            for row, text in enumerate(b.column(1).to_pylist()):
                ids = parts.encode(text or "") + end
                total = len(ids) // 4
                for start in range(0, total, size):
                    piece = ids[4 * start : 4 * (start + size)]
                    n = len(piece) // 4
                    out.append((row, start, n, zlib.crc32(piece), total, task, seen[n]))
                    seen[n] += 1
            rows, *columns = (pa.array(c, pa.int64()) for c in zip(*out))
            yield pa.RecordBatch.from_arrays([b.column(0).take(rows), *columns], ["_id", "start", "length", "ids_crc32", "doc_tokens", "task", "nth"])

    source = docs.select(F.col(id_column).alias("_id"), F.col(text_column).alias("_text"))
    return source.mapInArrow(cut, f"_id {source.schema['_id'].dataType.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long, task long, nth long")


def pack(docs: DataFrame, vocabulary: str, id_column: str = "doc_id", text_column: str = "text", size: int = SIZE, end_id: int = END_ID) -> DataFrame:
    """(id, start, length, ids_crc32, doc_tokens, sequence_id, offset): one row for each piece.  ``vocabulary``: a JSON file of
    ``tokenizers``; its special tokens that stand in a text become their ids."""
    pieces = materialize(pieces_of(docs, id_column, text_column, vocabulary, size, end_id), "pieces")
    counted = pieces.groupBy("length", "task").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    bases = counted.select("length", "task", F.coalesce(before, F.lit(0)).alias("base"))
    # one row for each length, at most `size`
    plan = layout({r.length: r.n for r in counted.groupBy("length").agg(F.sum("n").alias("n")).collect()}, size)
    shared = docs.sparkSession.sparkContext.broadcast(plan[np.lexsort((plan[:, 1], plan[:, 0]))])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = shared.value
        # rows are sorted by (length, first rank): both as one number, ranks being under 2**48
        keys = (rows[:, 0] << 48) + rows[:, 1]
        for b in batches:
            at = {name: b.column(i).to_numpy() for i, name in enumerate(b.schema.names) if name in ("length", "nth", "base")}
            rank = at["nth"] + at["base"]
            row = rows[np.searchsorted(keys, (at["length"] << 48) + rank, side="right") - 1]
            beyond = rank - row[:, 1]
            sequence, nth = row[:, 4] + beyond // np.maximum(row[:, 3], 1), beyond % np.maximum(row[:, 3], 1)
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(sequence), pa.array(row[:, 5] + nth * at["length"])], ["_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    placed = pieces.join(bases, ["length", "task"]).select("_id", "start", "length", "ids_crc32", "doc_tokens", "nth", "base")
    kind = placed.schema["_id"].dataType.simpleString()
    out = placed.mapInArrow(place, f"_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
    return out.withColumnRenamed("_id", id_column)
