"""Substring dedup with repeated-phrase automata.

A word goes if it lies in a window (``window`` consecutive words) that also starts in a document with a smaller id.

1. Anchors.  A window's anchor is the least hash of its runs of ``RUN`` words.  Equal windows have equal anchors, so a window
   can only recur if its anchor stands in two documents.  Anchors, about one for four words, are what is shuffled; not texts.
2. Passages.  Windows whose anchor recurs form passages of up to ``PASSAGE`` windows.  While a filter of all recurring
   anchors has at most ``MAX_FILTER_KEYS`` keys, it goes to the texts (false hits do no harm: windows are compared later);
   beyond, anchors are joined and texts shuffled to them.
3. Confirmation.  Equal passages are counted once.  All passages of an anchor meet in one shard, which finds the windows that stand
   in two documents, with the smallest id: these are the recurring passages.
4. Automata.  A shard compiles its recurring passages, window by window, into an Aho-Corasick automaton over word numbers, and streams
   through it the text about its anchors of all documents; offsets and smallest ids are what the automaton reports.  A window can only
   recur in text about a recurring anchor, so all other text needs no automaton, equal stretches of text are streamed once, and a
   stretch meets the automata of just those anchors that it holds: the work grows with the input and not with input times
   shards.  An anchor of over ``HOT`` different passages is cut into single windows, which are spread over the shards by their words, so
   no anchor, however common, meets in one task.
5. Removal.  Occurrences with a smaller first document return to their texts; texts that lose nothing are not shuffled
   while a filter of those that do is small enough.

Edge cases: null and empty texts, and texts shorter than a window, lose nothing.  A row with a null id loses nothing and
takes nothing from others.  Rows that share an id never take from one another; each is judged by itself.  Texts of any length
are handled whole.  Extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
import zstandard as zstd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.llm import bloom
from docweave.llm.common import materialize, per_step, steps

WINDOW = 13
#: Words of the runs whose least hash is a window's anchor.
RUN = 7
#: Windows in a passage at most.
PASSAGE = 16
#: Keys of a filter that is sent to all workers: 16 bits each, so 32 MB.
MAX_FILTER_KEYS = 16 << 20
#: Windows that a shard holds, unless one anchor has more: up to HOT x PASSAGE.
SHARD_WINDOWS = 10_000
#: Different passages of an anchor beyond which it is cut into windows.
HOT = 4096
#: Keys of eight bytes that a broadcast table may have.
BROADCAST_KEYS = 1 << 18
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_BYTE = np.array([int.from_bytes(hashlib.sha256(bytes([b])).digest()[:8], "little") | 1 for b in range(256)], dtype=np.uint64)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * _M1
    h = (h ^ (h >> np.uint64(32))) * _M2
    return h ^ (h >> np.uint64(31))


#: Inverse of _M1 modulo 2**64.
_BACK = np.uint64(pow(int(_M1), -1, 1 << 64))


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out)


def word_hashes(joined: bytes, ends: np.ndarray) -> np.ndarray:
    """A hash of each word of ``joined`` (words, single spaces between), all at once: differences of running sums."""
    data = _BYTE[np.frombuffer(joined, np.uint8)]
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(data * powers(_M1, len(data)))))
    starts = np.concatenate((np.zeros(1, np.int64), ends[:-1] + 1))
    # dividing by the power at a word's start makes its hash independent of where it stands
    return mixed((sums[ends] - sums[starts]) * powers(_BACK, len(data))[starts] + (ends - starts).astype(np.uint64))


def window_anchors(words: list[bytes], window: int, run: int) -> np.ndarray:
    """The anchor of each window of a text that has at least one."""
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    h = word_hashes(joined, ends)
    n = len(h) - run + 1
    runs = np.zeros(n, dtype=np.uint64)
    for k in range(run):
        runs = runs * _M2 + h[k : k + n]
    least = runs = mixed(runs)
    for k in range(1, window - run + 1):
        least = np.minimum(least[:-1], runs[k:])
    return least


def anchors_of(docs: DataFrame, window: int, run: int) -> DataFrame:
    """(doc_id, anchors array<long>): the distinct anchors of each text."""

    def find(b: pa.RecordBatch) -> pa.RecordBatch:
        ids, found = [], []
        for i, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist()):
            words = text.split()
            if len(words) >= window:
                ids.append(i)
                found.append(np.unique(window_anchors(words, window, run)).view(np.int64))
        offsets = np.concatenate(([0], np.cumsum([len(x) for x in found]))).astype(np.int32)
        values = pa.array(np.concatenate(found) if found else np.zeros(0, np.int64))
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), values)], ["doc_id", "anchors"])

    return docs.select("doc_id", "text").mapInArrow(per_step(find, "text"), "doc_id long, anchors array<long>")


def key_of(text: bytes) -> int:
    """Tells rows of one id apart."""
    return xxhash.xxh3_64_intdigest(text, 1) - (1 << 63)


def squeeze(ids: pa.Array, texts: list[bytes]) -> pa.RecordBatch:
    c = zstd.ZstdCompressor(level=3)
    return pa.RecordBatch.from_arrays([ids, pa.array([key_of(t) for t in texts], pa.int64()), pa.array([c.compress(t) for t in texts], pa.binary())], ["doc_id", "row_key", "packed"])


def squeezed(docs: DataFrame) -> DataFrame:
    """(doc_id, row_key, packed): texts are compressed before they are shuffled."""
    return docs.select("doc_id", "text").mapInArrow(per_step(lambda b: squeeze(b.column(0), b.column(1).cast(pa.binary()).to_pylist()), "text"), "doc_id long, row_key long, packed binary")


def unpack(packed: bytes) -> bytes:
    return zstd.ZstdDecompressor().decompress(packed) if packed else b""


PASSAGES = [("doc_id", pa.int64()), ("row_key", pa.int64()), ("first", pa.int32()), ("anchor", pa.int64()), ("key", pa.int64()), ("passage", pa.string())]
PASSAGES_SCHEMA = "doc_id long, row_key long, first int, anchor long, key long, passage string"


def cut_passages(words: list[bytes], least: np.ndarray, recurs: np.ndarray, window: int) -> Iterator[tuple[int, int, int, str]]:
    """(first window, anchor, key, words): runs of windows with one recurring anchor, in pieces of up to PASSAGE windows."""
    change = np.flatnonzero(least[1:] != least[:-1]) + 1
    starts, ends = np.concatenate(([0], change)), np.concatenate((change, [len(least)]))
    kept = recurs[starts]
    for s, e, anchor in zip(starts[kept].tolist(), ends[kept].tolist(), least[starts[kept]].tolist()):
        for f in range(s, e, PASSAGE):
            text = b" ".join(words[f : min(f + PASSAGE, e) + window - 1])
            yield f, anchor, xxhash.xxh3_64_intdigest(text) - (1 << 63), text.decode()


def passages_of(texts: Iterator[tuple[int, int, bytes, Callable[[np.ndarray], np.ndarray]]], window: int, run: int) -> pa.RecordBatch:
    rows: list[tuple] = []
    for doc_id, row_key, text, recurs in texts:
        words = text.split()
        if len(words) >= window:
            least = window_anchors(words, window, run).view(np.int64)
            rows += ((doc_id, row_key, *x) for x in cut_passages(words, least, recurs(least), window))
    columns = list(zip(*rows)) if rows else [[]] * len(PASSAGES)
    return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, (_, kind) in zip(columns, PASSAGES)], [n for n, _ in PASSAGES])


def passages_by_filter(docs: DataFrame, bits: Broadcast, window: int, run: int) -> DataFrame:
    """Passages whose anchor the filter lets pass, found where the texts are."""

    def find(b: pa.RecordBatch) -> pa.RecordBatch:
        recurs = lambda least: bloom.contains(bits.value, least.view(np.uint64))
        texts = b.column(1).cast(pa.binary()).to_pylist()
        return passages_of(((i, key_of(t), t, recurs) for i, t in zip(b.column(0).to_pylist(), texts)), window, run)

    return docs.select("doc_id", "text").mapInArrow(per_step(find, "text"), PASSAGES_SCHEMA)


def passages_by_join(docs: DataFrame, anchors: DataFrame, recurring: DataFrame, window: int, run: int) -> DataFrame:
    """Passages of recurring anchors, which are joined with texts by document."""
    known = anchors.join(recurring, "anchor").groupBy("doc_id").agg(F.collect_set("anchor").alias("anchors"))

    def find(b: pa.RecordBatch) -> pa.RecordBatch:
        rows = zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3))
        return passages_of(((i, key, unpack(z), lambda least, a=a.values.to_numpy(): np.isin(least, a)) for i, key, z, a in rows), window, run)

    return squeezed(docs).join(known, "doc_id").select("doc_id", "row_key", "packed", "anchors").mapInArrow(per_step(find, "packed"), PASSAGES_SCHEMA)


#: Rows that are aggregated at once before the shuffle.
MERGED_ROWS = 1 << 15


def merged(found: DataFrame) -> DataFrame:
    """(anchor, key, passage, least, most): equal passages of a task in one row, as far as MERGED_ROWS reach.

    Spark's own partial aggregation would need one shuffle by passage and another by anchor.
    """
    names = ["anchor", "key", "passage", "least", "most"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def merge() -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(held).group_by(["anchor", "key"], use_threads=False).aggregate([("passage", "first"), ("doc_id", "min"), ("doc_id", "max")])
            yield from t.select(["anchor", "key", "passage_first", "doc_id_min", "doc_id_max"]).rename_columns(names).to_batches(max_chunksize=8192)

        held: list[pa.RecordBatch] = []
        for b in batches:
            held.append(b)
            if sum(x.num_rows for x in held) >= MERGED_ROWS:
                yield from merge()
                held = []
        if held:
            yield from merge()

    return found.select("anchor", "key", "passage", "doc_id").mapInArrow(run, "anchor long, key long, passage string, least long, most long")


class Shard:
    """Passages of some anchors, all that have those anchors, with the least and greatest id of each passage.

    Passages stand one after another in a line of word numbers (from 1), with a zero after each.
    """

    def __init__(self, window: int):
        self.window, self.numbers = window, {}
        self.line: list[int] = []
        self.rows: list[tuple[int, int, int, int, int]] = []  # anchor, key, windows, least, most
        self.windows = 0

    def add(self, anchor: int, key: int, passage: str, least: int, most: int) -> None:
        numbers, before = self.numbers, len(self.line)
        self.line += [numbers.setdefault(w, len(numbers) + 1) for w in passage.split(" ")]
        n = len(self.line) - before - self.window + 1
        self.line.append(0)
        self.rows.append((anchor, key, n, least, most))
        self.windows += n

    def recurring(self, line: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where one of each sort of equal windows that two documents hold starts, and the smallest id of each sort."""
        n = np.array([r[2] for r in self.rows])
        least, most = (np.repeat(np.array([r[i] for r in self.rows], dtype=np.int64), n) for i in (3, 4))
        for salt in range(1, 100):
            hashes = np.zeros(len(starts), np.uint64)
            for k in range(self.window):
                hashes += line[starts + k].astype(np.uint64) * np.uint64(pow(0x9E3779B97F4A7C15 + 2 * salt, k + 1, 1 << 64))
            order = np.argsort(hashes, kind="stable")
            new = np.concatenate(([True], hashes[order][1:] != hashes[order][:-1]))
            first = np.flatnonzero(new)
            one = starts[order][first]
            lead = np.repeat(one, np.diff(np.concatenate((first, [len(starts)]))))
            if all((line[starts[order] + k] == line[lead + k]).all() for k in range(self.window)):
                least, most = np.minimum.reduceat(least[order], first), np.maximum.reduceat(most[order], first)
                return one[least < most], least[least < most]
        raise ValueError("no base tells the windows apart")

    def automaton(self, line: np.ndarray, windows: np.ndarray, least: np.ndarray) -> ahocorasick.Automaton:
        """Of the recurring passages, window by window: a match tells where one ends and the smallest id that holds it."""
        machine = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for words, i in zip(map(tuple, line[windows[:, None] + np.arange(self.window)].tolist()), least.tolist()):
            machine.add_word(words, i)
        machine.make_automaton()
        return machine

    def located(self) -> pa.RecordBatch | None:
        """(anchor, key, firsts) of passages in which the automaton finds occurrences: each window's smallest id, or null."""
        w = self.window
        line = np.array(self.line, dtype=np.int64)
        n = np.array([r[2] for r in self.rows])
        begin = np.cumsum(n + w) - (n + w)  # of each passage in the line
        before = np.cumsum(n) - n  # windows of the passages before it
        starts = np.repeat(begin - before, n) + np.arange(n.sum())
        windows, least = self.recurring(line, starts)
        if not len(windows):
            return None
        first, found = np.zeros(len(line), np.int64), np.zeros(len(line), bool)
        for end, i in self.automaton(line, windows, least).iter(tuple(self.line)):
            first[end - w + 1], found[end - w + 1] = i, True
        some = np.add.reduceat(found[starts], before) > 0
        rows, held = np.flatnonzero(some), starts[np.repeat(some, n)]
        firsts = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n[rows]))), pa.int32()), pa.array(first[held], pa.int64(), mask=~found[held]))
        return pa.RecordBatch.from_arrays([pa.array([self.rows[i][0] for i in rows], pa.int64()), pa.array([self.rows[i][1] for i in rows], pa.int64()), firsts], ["anchor", "key", "firsts"])


def locate(distinct: DataFrame, window: int) -> DataFrame:
    """(anchor, key, firsts) from (anchor, key, passage, least, most), sorted by anchor within partitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, last = Shard(window), None
        for b in steps(batches, "passage", rows=1024):
            for anchor, key, passage, least, most in zip(*(b.column(i).to_pylist() for i in range(5))):
                if shard.windows >= SHARD_WINDOWS and anchor != last:
                    if (out := shard.located()) is not None:
                        yield out
                    shard = Shard(window)
                shard.add(anchor, key, passage, least, most)
                last = anchor
        if shard.rows and (out := shard.located()) is not None:
            yield out

    return distinct.select("anchor", "key", "passage", "least", "most").mapInArrow(run, "anchor long, key long, firsts array<long>")


def by_window(passages: DataFrame, window: int) -> DataFrame:
    """Passages cut into single windows, each with a hash of its own words for an anchor."""

    def cut(b: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for doc_id, row_key, first, _, _, passage in zip(*(c.to_pylist() for c in b.columns)):
            words = passage.split(" ")
            for i in range(len(words) - window + 1):
                part = " ".join(words[i : i + window])
                rows.append((doc_id, row_key, first + i, xxhash.xxh3_64_intdigest(part, 2) - (1 << 63), xxhash.xxh3_64_intdigest(part) - (1 << 63), part))
        return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, (_, kind) in zip(zip(*rows), PASSAGES)], [n for n, _ in PASSAGES])

    return passages.select(*(n for n, _ in PASSAGES)).mapInArrow(per_step(cut, "passage"), PASSAGES_SCHEMA)


def few(keys: DataFrame) -> DataFrame | None:
    """None if there are no keys; keys of a counted number that is small are broadcast, others joined."""
    n = keys.count()
    return None if not n else F.broadcast(keys) if n <= BROADCAST_KEYS else keys


def without_hot_anchors(found: DataFrame, recurring: DataFrame, window: int, hot: int) -> DataFrame:
    """``found``, the passages of anchors with over ``hot`` different ones cut into windows."""
    many = few(recurring.where(F.col("n") > hot).select("anchor"))  # only what many documents hold can have as many passages
    if many is None:
        return found
    different = found.select("anchor", "key").join(many, "anchor", "left_semi").distinct().groupBy("anchor").count()
    crowded = few(materialize(different.where(F.col("count") > hot).select("anchor"), "hot"))
    if crowded is None:
        return found
    cut = materialize(by_window(found.join(crowded, "anchor", "left_semi"), window), "windows")
    return found.join(crowded, "anchor", "left_anti").unionByName(cut)


def without_windows(words: list[bytes], starts: np.ndarray, window: int) -> tuple[int, int, bytes, list[dict[str, int]]]:
    """Words, words removed, the others single-spaced, and the word ranges removed."""
    change = np.zeros(len(words) + 1, np.int64)
    change[starts] += 1
    change[starts + window] -= 1
    gone = np.cumsum(change[:-1]) > 0
    edges = np.flatnonzero(np.diff(np.concatenate(([0], gone.astype(np.int8), [0]))))
    kept = words if not len(edges) else [x for x, g in zip(words, gone.tolist()) if not g]
    return len(words), int(gone.sum()), b" ".join(kept), [{"first": int(s), "words": int(e - s)} for s, e in zip(edges[::2], edges[1::2])]


RESULT = [("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string()), ("spans", pa.list_(pa.struct([("first", pa.int64()), ("words", pa.int64())])))]
RESULT_SCHEMA = "doc_id long, n_words long, n_removed long, kept string, spans array<struct<first:long,words:long>>"


def results(ids: pa.Array, found: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([ids, *(pa.array([x[i] for x in found], kind) for i, (_, kind) in enumerate(RESULT))], ["doc_id", *(n for n, _ in RESULT)])


def removed(texts: DataFrame, window: int) -> DataFrame:
    """From (doc_id, packed, starts): starts are the windows to remove, or null."""

    def cut(b: pa.RecordBatch) -> pa.RecordBatch:
        at = (np.unique(s.values.to_numpy()) if s.is_valid else np.zeros(0, np.int64) for s in b.column(2))
        return results(b.column(0), [without_windows(unpack(z).split(), s, window) for z, s in zip(b.column(1).to_pylist(), at)])

    return texts.select("doc_id", "packed", "starts").mapInArrow(per_step(cut, "packed"), RESULT_SCHEMA)


def parted(docs: DataFrame, bits: Broadcast, window: int) -> tuple[DataFrame, DataFrame]:
    """Results of the rows that lose nothing, and (doc_id, row_key, packed) of those that may: the filter holds hashes of
    (doc_id, row_key).  Each row falls to one of the two by the same test."""

    def passes(b: pa.RecordBatch) -> tuple[list[bytes], np.ndarray]:
        texts = b.column(1).cast(pa.binary()).to_pylist()
        ids = b.column(0).to_pylist()
        h = np.array([row_hash(i, key_of(t)) for i, t in zip(ids, texts)], dtype=np.uint64)
        return texts, bloom.contains(bits.value, h)

    def same(b: pa.RecordBatch) -> pa.RecordBatch:
        texts, may = passes(b)
        none = np.zeros(0, np.int64)
        return results(b.column(0).filter(pa.array(~may)), [without_windows(t.split(), none, window) for t, m in zip(texts, may) if not m])

    def others(b: pa.RecordBatch) -> pa.RecordBatch:
        texts, may = passes(b)
        return squeeze(b.column(0).filter(pa.array(may)), [t for t, m in zip(texts, may) if m])

    source = docs.select("doc_id", "text")
    return source.mapInArrow(per_step(same, "text"), RESULT_SCHEMA), source.mapInArrow(per_step(others, "text"), "doc_id long, row_key long, packed binary")


def row_hash(doc_id: int | None, row_key: int) -> int:
    return xxhash.xxh3_64_intdigest(f"{doc_id}/{row_key}")


def hashed_rows(rows: DataFrame) -> DataFrame:
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h = np.array([row_hash(i, k) for i, k in zip(b.column(0).to_pylist(), b.column(1).to_pylist())], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64))], ["h"])

    return rows.select("doc_id", "row_key").mapInArrow(add, "h long")


def dedup_substrings(docs: DataFrame, window: int = WINDOW, run: int = RUN, max_filter_keys: int = MAX_FILTER_KEYS, hot: int = HOT) -> DataFrame:
    """(doc_id, n_words, n_removed, kept, spans): ``kept`` is the text's other words, single-spaced; spans are word ranges."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    run, spark = min(run, window), docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    named = docs.where("doc_id IS NOT NULL")
    anchors = anchors_of(named, window, run).select("doc_id", F.explode("anchors").alias("anchor"))
    # minima are pre-aggregated before the shuffle, so an anchor that a third of the texts hold costs a row for each task
    recurring = materialize(anchors.groupBy("anchor").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.count("*").alias("n")).where("least < most").select("anchor", "n"), "anchors")
    keys = recurring.count()
    if keys <= max_filter_keys:
        cut = passages_by_filter(named, spark.sparkContext.broadcast(bloom.build(recurring.select("anchor"), keys, 2 * MAX_FILTER_KEYS)), window, run)
    else:
        cut = passages_by_join(named, anchors, recurring.select("anchor"), window, run)
    found = without_hot_anchors(materialize(cut, "passages"), recurring, window, hot)
    by_anchor = merged(found).repartition(n, "anchor")
    distinct = by_anchor.groupBy("anchor", "key").agg(F.first("passage").alias("passage"), F.min("least").alias("least"), F.max("most").alias("most"))
    located = locate(distinct.sortWithinPartitions("anchor"), window)
    hits = found.select("doc_id", "row_key", "first", "anchor", "key").join(located, ["anchor", "key"])
    windows = hits.select("doc_id", "row_key", F.expr("filter(transform(firsts, (x, i) -> if(x < doc_id, cast(first + i as long), null)), x -> x is not null)").alias("at")).where("size(at) > 0")
    starts = materialize(windows.groupBy("doc_id", "row_key").agg(F.flatten(F.collect_list("at")).alias("starts")), "starts")
    changed = starts.count()
    if changed > max_filter_keys:
        return removed(squeezed(docs).join(starts, ["doc_id", "row_key"], "left"), window)
    same, others = parted(docs, spark.sparkContext.broadcast(bloom.build(hashed_rows(starts), changed, 2 * MAX_FILTER_KEYS)), window)
    return same.unionByName(removed(others.join(starts, ["doc_id", "row_key"], "left"), window))
