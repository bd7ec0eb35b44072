"""Benchmark decontamination: one Aho-Corasick automaton over normalised test items, one scan of each text.

Texts and items are lower-cased (A-Z) and cut into words; every other ASCII character separates words.  A window is ``window``
consecutive words of an item, or the whole item if that is shorter.

Windows overlap, so an automaton of all of them would hold each word ``window`` times.  This one, over word numbers, holds
*seeds*: of every item the runs of ``window // 2`` words that begin at each ``window - window // 2 + 1``-th word, and its last
one; every window holds a seed whole.  Where a seed occurs in a text, the words around it are compared with those around the
seed in the items; a run of at least ``window`` words in common consists of windows, and every occurring window is found so.
Shorter items are patterns by themselves.  Word numbers lead back to character offsets of the original text.

What a worker holds is bounded: items beyond ``PART_CHARS`` characters are taken in parts, one after another, each by a pass of
its own over the texts, so one automaton is in memory at a time.  No benchmark is too long.

Edge cases: null and empty texts have no words and no hits; items without words give no window; repeated items and windows
are held once; windows may overlap and each occurrence counts.  Windows of items with a null id count as hits, without an id.
Rows are judged one by one, whatever their ids.  The operator's columns take the place of kept columns of their names.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections import defaultdict
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructType

from docweave.llm.common import aside, materialize, per_step

#: Words as they stand in the original, upper case included.
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
#: Upper case to lower, every separating byte to a space, all others as they are.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Characters of items (each distinct text once) that one automaton is built from.
PART_CHARS = 32 << 20
_built: dict[str, Machine] = {}


def words_of(text: bytes | None) -> list[bytes]:
    return [w for w in (text or b"").translate(FOLD).split(b" ") if w]


class Items:
    """Distinct items of a part as word numbers, in one array with a negative number after each; numbers are from 1."""

    def __init__(self) -> None:
        self.numbers: dict[bytes, int] = {}
        self.ids: list[tuple[str, ...]] = []
        self.words: list[np.ndarray] = []
        self.chars = 0

    def add(self, words: list[bytes], ids: Iterable[str]) -> None:
        numbers = self.numbers
        self.ids.append(tuple(ids))
        self.words.append(np.array([numbers.setdefault(w, len(numbers) + 1) for w in words] + [-1], dtype=np.int32))
        self.chars += sum(map(len, words)) + len(words)

    def packed(self) -> tuple[bytes, np.ndarray, list[tuple[str, ...]]]:
        """What is sent to the workers: the words in the order of their numbers, the array, and the items' ids."""
        return b" ".join(self.numbers), np.concatenate([np.array([-1], np.int32), *self.words]), self.ids


def parts_of(items: DataFrame, id_column: str, text_column: str, part_chars: int) -> Iterator[Items]:
    """Distinct texts with the ids of all items that have them, in parts of about ``part_chars`` characters."""
    rows = items.where(F.col(text_column).isNotNull()).groupBy(F.col(text_column).alias("t")).agg(F.array_sort(F.collect_set(F.col(id_column).cast("string"))).alias("ids"))
    part = Items()
    for row in rows.orderBy("t").toLocalIterator():
        if words := words_of(row.t.encode()):
            if part.chars and part.chars + len(row.t) > part_chars:
                yield part
                part = Items()
            part.add(words, row.ids)
    if part.ids:
        yield part


class Machine:
    """The automaton of a part, built once in each worker, and the part's windows in the order of their hashes."""

    def __init__(self, packed: tuple[bytes, np.ndarray, list[tuple[str, ...]]], window: int):
        words, self.array, self.ids = packed
        self.numbers = {w: i for i, w in enumerate(words.split(b" "), 1)}
        self.window, self.seed = window, max(1, window // 2)
        self.bounds = np.flatnonzero(self.array < 0)  # an item is between two of these
        seeds: set[tuple[int, ...]] = set()
        whole: dict[tuple[int, ...], list[int]] = defaultdict(list)
        step = window - self.seed + 1
        for first, end in zip((self.bounds[:-1] + 1).tolist(), self.bounds[1:].tolist()):
            if end - first < window:
                whole[tuple(self.array[first:end].tolist())].append(first)
            else:
                last = end - self.seed
                seeds.update(tuple(self.array[at : at + self.seed].tolist()) for at in [*range(first, last, step), last])
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for key in seeds | whole.keys():
            self.automaton.add_word(key, (len(key), key in seeds, whole.get(key)))
        if len(self.automaton):
            self.automaton.make_automaton()
        self.index()

    def index(self) -> None:
        """Places of windows sorted by hash; one hash has one window, or another base is taken."""
        w, n = self.window, max(0, len(self.array) - self.window + 1)
        free = np.ones(n, dtype=bool)
        for k in range(w):
            free &= self.array[k : k + n] >= 0
        starts = np.flatnonzero(free)
        for salt in range(1, 100):
            self.powers = np.array([pow(0x9E3779B97F4A7C15 + 2 * salt, k + 1, 1 << 64) for k in range(w)], dtype=np.uint64)
            hashes = self.hashes(self.array, starts)
            order = np.argsort(hashes, kind="stable")
            hashes, places = hashes[order], starts[order]
            new = np.concatenate((np.ones(min(1, len(hashes)), bool), hashes[1:] != hashes[:-1]))
            lead = places[np.flatnonzero(new)[np.cumsum(new) - 1]] if len(places) else places
            if all((self.array[places + k] == self.array[lead + k]).all() for k in range(w)):
                break
        else:
            raise ValueError("no base tells the windows apart")
        self.places, self.first = places.astype(np.int32 if len(self.array) < 1 << 31 else np.int64), np.append(np.flatnonzero(new), len(places))
        self.distinct = hashes[self.first[:-1]]

    def hashes(self, array: np.ndarray, starts: np.ndarray) -> np.ndarray:
        out = np.zeros(len(starts), np.uint64)
        for k, power in enumerate(self.powers):
            out += (array[starts + k].astype(np.uint64) + np.uint64(1)) * power
        return out ^ (out >> np.uint64(31))

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Word ranges in common with windows, and the items whose windows occur."""
        w, s, n = self.window, self.seed, len(words)
        get = self.numbers.get
        line = tuple([get(x, 0) for x in words])
        ranges: list[tuple[int, int]] = []
        items: set[str] = set()
        if not len(self.automaton) or not any(line):
            return ranges, items
        near: list[int] = []  # first words of seeds
        short: dict[int, list[int]] = {}
        for end, (size, seed, whole) in self.automaton.iter(line):
            if seed:
                near.append(end - s + 1)
            if whole:
                ranges.append((end - size + 1, end + 1))
                short[whole[0]] = whole
        for places in short.values():
            self.name(np.array(places), items)
        if near and n >= w:
            change = np.zeros(n + w + 1, np.int64)
            at = np.array(near)
            np.add.at(change, np.maximum(at - (w - s), 0), 1)
            np.add.at(change, at + 1, -1)
            starts = np.flatnonzero(np.cumsum(change)[: n - w + 1])
            array = np.array(line, np.int64)
            hashes = self.hashes(array, starts)
            found = np.minimum(np.searchsorted(self.distinct, hashes), len(self.distinct) - 1)
            same = self.distinct[found] == hashes
            lead = self.places[self.first[found]].astype(np.int64)
            for k in range(w):
                same &= self.array[lead + k] == array[starts + k]
            ranges += [(i, i + w) for i in starts[same].tolist()]
            for i in np.unique(found[same]).tolist():
                self.name(self.places[self.first[i] : self.first[i + 1]], items)
        return ranges, items

    def name(self, places: np.ndarray, items: set[str]) -> None:
        for i in np.unique(np.searchsorted(self.bounds, places, side="right") - 1).tolist():
            items.update(self.ids[i])


def machine(token: str, shared: Broadcast, window: int) -> Machine:
    if token not in _built:
        _built.clear()  # one at a time
        _built[token] = Machine(shared.value, window)
    return _built[token]


def runs(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ranges that overlap or touch as one."""
    out: list[list[int]] = []
    for first, end in sorted(ranges):
        if out and first <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([first, end])
    return [(a, b) for a, b in out]


def spans(text: str, hit: list[tuple[int, int]]) -> list[dict[str, int]]:
    """Character ranges of the original text that ranges of words cover."""
    if not hit:
        return []
    places = [m.span() for m in WORD.finditer(text)]
    return [{"start": places[first][0], "end": places[end - 1][1]} for first, end in hit]


RESULT = StructType().add("n_words", LongType()).add("n_hit", LongType()).add("item_ids", ArrayType(StringType())).add("spans", ArrayType(StructType().add("start", LongType()).add("end", LongType())))
_ARROW_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_ARROW_RANGES = pa.list_(pa.list_(pa.int64()))


def contamination(docs: DataFrame, items: DataFrame, window: int = 10, id_column: str = "doc_id", text_column: str = "text", item_id: str = "item_id", item_text: str = "text", keep: list[str] | None = None, part_chars: int = PART_CHARS) -> DataFrame:
    """``keep`` columns (the id by default), n_words, n_hit, item_ids, and spans: character ranges of the original that are hit."""
    carried, names = aside(docs, keep or [id_column], RESULT.names)
    # so far: word ranges hit, and ids of items
    now = docs.select(*carried, F.expr("cast(null as array<array<bigint>>)").alias("_ranges"), F.expr("cast(null as array<string>)").alias("_items"), F.col(text_column).alias("_text"))
    kept = StructType(now.schema.fields[:-3])
    parts = parts_of(items, item_id, item_text, part_chars)
    part, more = next(parts, None), next(parts, None)
    while True:
        out = StructType([*now.schema.fields]) if more else StructType([*kept.fields, *RESULT.fields])
        scanner = pass_of(docs, part, window, out, final=more is None)
        now = now.mapInArrow(per_step(scanner, "_text"), out)
        if not more:
            return now.toDF(*names, *RESULT.names)
        now, part, more = materialize(now, "scanned"), more, next(parts, None)


def pass_of(docs: DataFrame, part: Items | None, window: int, out: StructType, final: bool):
    """What scans a batch for the windows of one part."""
    token = uuid.uuid4().hex
    shared = docs.sparkSession.sparkContext.broadcast(part.packed()) if part else None

    def judge(b: pa.RecordBatch) -> pa.RecordBatch:
        built = machine(token, shared, window) if shared else None
        found = []
        for ranges, ids, text in zip(*(b.column(b.num_columns - i).to_pylist() for i in (3, 2, 1))):
            words = words_of(text.encode()) if text else []
            new, items = built.scan(words) if built and words else ([], set())
            found.append((len(words), runs([*map(tuple, ranges or ()), *new]), sorted(items.union(ids or ())), text))
        ids = pa.array([i for _, _, i, _ in found], pa.list_(pa.string()))
        if not final:
            return pa.RecordBatch.from_arrays([*b.columns[:-3], pa.array([r for _, r, _, _ in found], _ARROW_RANGES), ids, b.column(b.num_columns - 1)], out.names)
        columns = [pa.array([n for n, _, _, _ in found], pa.int64()), pa.array([sum(e - f for f, e in r) for _, r, _, _ in found], pa.int64()), ids, pa.array([spans(t, r) for _, r, _, t in found], _ARROW_SPANS)]
        return pa.RecordBatch.from_arrays([*b.columns[:-3], *columns], out.names)

    return judge


def digest(ids: list[str]) -> str:
    """What a query reports of a document's items: SHA-256 of the sorted ids, comma-joined."""
    return hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
