"""SimHash near-duplicates through a hierarchical index in Gray order.

Each document gets a 64-bit fingerprint of its word shingles.  Distinct fingerprints are what is indexed: exact copies cost
one entry.  The index's top nodes are shared bit patterns under a mask: two fingerprints that differ in at most ``distance``
bits agree fully on one of ``distance + 1`` equal blocks of bits, so a fingerprint enters one top node for each block.  Below a
top node fingerprints are sorted by Gray rank, and runs of 16 are factored into nodes that hold the bits all members share
(pattern and mask), level by level.  A search pairs nodes from the top, accumulates the bits in which their shared patterns
differ, and drops a pair of whole groups once that exceeds the distance.

A top node with over ``HOT`` members is split again by blocks of its remaining bits, which loses no pair for the same reason.
A node gives star edges (member, smallest linked member), never all pairs, so output stays linear in the input.  A split parts
members by 24 bits of 64 at distance three; those that agree on them meet in one task, where the index prunes them by groups.

``similar_documents`` finds all documents whose word shingles have a given Jaccard similarity, of which one fingerprint in three bits
sees only the most similar.  It puts a text's distinct shingles in an order that is the same for all texts; two sets that similar share
one of so many first ones, and more of them the nearer in size.  Pairs that share enough of these are first held against each other by
parity sketches, whose differing bits are no more than the shingles that only one of two texts has, so no similar pair is lost; those
left are compared on all shingles.

Edge cases: null and empty texts, and texts of white space, have fingerprint zero and are linked like any other.  Texts with
fewer words than a shingle give one shingle of all words.  Repeated rows link at distance zero.  Rows with a null id keep
their fingerprint, take part in links, and count after all other ids when the smallest is chosen.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.llm.common import materialize, per_step
from docweave.llm.components import components

SEED = 42
#: Members of a top node beyond which it is split by a second block.
HOT = 20_000
#: Children of an index node.
FAN = 16
#: Node pairs looked at at once; bounds memory.
FRONTIER = 1 << 19
#: Hot top nodes (twelve bytes each) that are broadcast.
BROADCAST_NODES = 1 << 18
#: Holders of a first shingle beyond which it is common: they are linked by stars before they are paired.
FEW = 16
#: One text in so many is looked at for common shingles; texts among these that hold one; common shingles (eight bytes each) at most.
SOME, OFTEN, MOST_COMMON = 16, 3, 1 << 19
#: Words of 64 bits of a parity sketch.
WORDS = 8
LANES = np.uint64(0x0101010101010101)
LOWER, SPACES = "abcdefghijklmnopqrstuvwxyz", r"[\x20\x09-\x0D]+"


def fingerprints(texts: list[bytes], shingle: int) -> np.ndarray:
    """SimHash of each text (UTF-8): bit set if set in over half of the shingles' XXH64 (seed 42)."""
    hashed, counts = shingle_hashes(texts, shingle)
    return majority(joined(hashed), counts)


def joined(hashed: list[np.ndarray]) -> np.ndarray:
    return np.concatenate(hashed) if hashed else np.zeros(0, np.uint64)


def shingle_hashes(texts: list[bytes], shingle: int) -> tuple[list[np.ndarray], list[int]]:
    """Hashes of each text's shingles, without those of texts that have none, and how many each text has."""
    digest, hashed, counts = xxhash.xxh64_intdigest, [], []
    for text in texts:
        words = text.lower().split()  # bytes: A-Z and ASCII white space only
        if not words:
            counts.append(0)
            continue
        if len(words) <= shingle:
            h = [digest(b" ".join(words), SEED)]
        else:
            joined = b" ".join(words)
            ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
            starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - shingle + 1].tolist()
            h = [digest(joined[a:b], SEED) for a, b in zip(starts, ends[shingle - 1 :].tolist())]
        hashed.append(np.array(h, dtype=np.uint64))
        counts.append(len(h))
    return hashed, counts


def majority(h: np.ndarray, counts: list[int]) -> np.ndarray:
    """The bits set in over half of each text's hashes, which follow one another; zero for none."""
    n = np.array(counts, dtype=np.int64)
    out = np.zeros(len(counts), dtype=np.uint64)
    full = np.flatnonzero(n)
    if not len(full):
        return out
    # eight bit positions are counted at once, in the bytes of a word, over at most 255 hashes; these sums are then added up
    first = np.concatenate(([0], np.cumsum(n[full])[:-1]))
    pieces = -(-n[full] // 255)
    at = np.repeat(first, pieces) + 255 * (np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces))
    owner = np.cumsum(pieces) - pieces
    found = np.zeros(len(full), dtype=np.uint64)
    for k in range(8):
        sums = np.add.reduceat((h >> np.uint64(k)) & LANES, at).view(np.uint8).reshape(-1, 8).astype(np.int64)
        totals = np.add.reduceat(sums, owner, axis=0)
        for j in range(8):
            found |= (2 * totals[:, j] > n[full]).astype(np.uint64) << np.uint64(8 * j + k)
    out[full] = found
    return out


def with_fingerprints(docs: DataFrame, id_column: str, text_column: str, shingle: int) -> DataFrame:
    """(id, fp long): one row per input row."""
    kind = docs.schema[id_column].dataType.simpleString()

    def add(b: pa.RecordBatch) -> pa.RecordBatch:
        fp = fingerprints([x or b"" for x in b.column(1).cast(pa.binary()).to_pylist()], shingle)
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], [id_column, "fp"])

    return docs.select(id_column, text_column).mapInArrow(per_step(add, text_column), f"`{id_column}` {kind}, fp long")


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Position of each code in the reflected Gray sequence."""
    out = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        out ^= out >> np.uint64(s)
    return out


class GrayIndex:
    """Runs of FAN codes in Gray order, and runs of those, each with the bits its members share; one root for each key."""

    def __init__(self, key: np.ndarray, codes: np.ndarray):
        order = np.lexsort((gray_rank(codes), key))
        self.order, k, pattern, mask = order, key[order], codes[order], np.full(len(codes), ~np.uint64(0))
        self.levels: list[tuple[np.ndarray, ...]] = [(pattern, mask, np.zeros(0, np.int64), np.zeros(0, np.int64))]
        while len(k) and (k[1:] == k[:-1]).any():
            new = np.concatenate(([True], k[1:] != k[:-1]))
            group = np.flatnonzero(new)
            within = np.arange(len(k)) - np.repeat(group, np.diff(np.append(group, len(k))))
            start = np.flatnonzero(within % FAN == 0)
            size = np.diff(np.append(start, len(k)))
            lead = np.repeat(pattern[start], size)
            mask = ~np.bitwise_or.reduceat((pattern ^ lead) | ~mask, start)
            pattern, k = pattern[start] & mask, k[start]
            self.levels.append((pattern, mask, start, size))

    def pairs(self, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Positions, in the given order of codes, of pairs within the distance, in pieces of bounded size."""
        top = len(self.levels) - 1
        roots = np.arange(len(self.levels[top][0]))
        todo = [(top, roots, roots)]
        while todo:
            level, a, b = todo.pop()
            if not level:
                yield self.order[a], self.order[b]
                continue
            _, _, start, size = self.levels[level]
            pattern, mask = self.levels[level - 1][:2]
            for i in range(0, len(a), FRONTIER // FAN**2):
                x, y = a[i : i + FRONTIER // FAN**2], b[i : i + FRONTIER // FAN**2]
                n = size[x] * size[y]
                pair = np.repeat(np.arange(len(x)), n)
                nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                c, d = start[x][pair] + nth // size[y][pair], start[y][pair] + nth % size[y][pair]
                # within one node each pair of children once; a child meets itself only while it still has members to part
                keep = (x[pair] != y[pair]) | ((c <= d) if level > 1 else (c < d))
                keep &= np.bitwise_count((pattern[c] ^ pattern[d]) & mask[c] & mask[d]) <= distance
                if keep.any():
                    todo.append((level - 1, c[keep], d[keep]))


def link(key: np.ndarray, codes: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """For each code, the smallest position that links of its own key lead to, and the smallest that it is linked with itself."""
    label, near = np.arange(len(codes)), np.arange(len(codes))
    for a, b in GrayIndex(key, codes).pairs(distance):
        np.minimum.at(near, np.maximum(a, b), np.minimum(a, b))
        while True:
            x, y = label[a], label[b]
            differ = x != y
            if not differ.any():
                break
            np.minimum.at(label, np.maximum(x, y)[differ], np.minimum(x, y)[differ])
            while (label != (up := label[label])).any():
                label = up
    return label, near


def star_edges(batches: Iterator[pa.RecordBatch], distance: int, direct: bool) -> Iterator[pa.RecordBatch]:
    """Rows (node long, fp long, tag int) sorted by node, in; edges (u, v, tag) out.  A node that crosses a batch's end waits for
    the next.  ``direct`` adds each code's edge to the smallest within the distance, which may not be the smallest reached."""
    held: tuple[np.ndarray, ...] | None = None

    def out(key: np.ndarray, codes: np.ndarray, tag: np.ndarray) -> Iterator[pa.RecordBatch]:
        reached, near = link(key, codes, distance)
        for label in (reached, np.where(near == reached, np.arange(len(codes)), near)) if direct else (reached,):
            if (linked := label != np.arange(len(label))).any():
                yield pa.RecordBatch.from_arrays([pa.array(codes[linked].view(np.int64)), pa.array(codes[label][linked].view(np.int64)), pa.array(tag[linked])], ["u", "v", "tag"])

    for b in batches:
        now = b.column(0).to_numpy(), b.column(1).to_numpy().view(np.uint64), b.column(2).to_numpy()
        if held:
            now = tuple(np.concatenate(x) for x in zip(held, now))
        if not len(now[0]):
            continue
        cut = np.searchsorted(now[0], now[0][-1])  # sorted: the last node starts here
        held = tuple(x[cut:].copy() for x in now)
        if cut:
            yield from out(*(x[:cut] for x in now))
    if held:
        yield from out(*held)


def block_key(fp, widths: list[tuple[int, int]], mask: int | None = None):
    """An array of one key for each block (shift, width): the block's number and bits."""
    return F.array(*(F.shiftleft(F.lit(i + 1).cast("long"), 32).bitwiseOR(F.shiftrightunsigned(fp, s).bitwiseAND((1 << w) - 1)) for i, (s, w) in enumerate(widths)))


def blocks_of(bits: int, n: int, at: int = 0) -> list[tuple[int, int]]:
    cuts = [at + bits * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def links(codes: DataFrame, distance: int, direct: bool = False) -> DataFrame:
    """Star edges (u, v, tag) among distinct fingerprints (fp, tag), within each tag; reaching along them equals reaching along all
    links.  Without a column ``tag`` all have tag zero."""
    if "tag" not in codes.columns:
        codes = codes.select("fp", F.lit(0).alias("tag"))
    wide = blocks_of(64, distance + 1)
    nodes = codes.select("fp", "tag", F.explode(block_key(F.col("fp"), wide)).alias("top"))
    hot = materialize(nodes.groupBy("tag", "top").count().where(F.col("count") > HOT).select("tag", "top"), "hot")
    crowded = hot.count()
    every = nodes.select(F.xxhash64("tag", "top", F.lit(0)).alias("node"), "fp", "tag")
    if crowded:
        if crowded <= BROADCAST_NODES:
            hot = F.broadcast(hot)
        cool = nodes.join(hot, ["tag", "top"], "left_anti").select(F.xxhash64("tag", "top", F.lit(0)).alias("node"), "fp", "tag")
        # at most `distance` of the other blocks' bits differ, so two members agree on one of 2 * distance parts of them
        parts = []
        for i in range(distance + 1):
            rest = [w for j, w in enumerate(wide) if j != i]
            fine = [p for s, w in rest for p in blocks_of(w, 2, s)]
            parts.append(F.when(F.shiftrightunsigned("top", 32) == i + 1, block_key(F.col("fp"), fine)))
        warm = nodes.join(hot, ["tag", "top"], "left_semi").select("fp", "tag", "top", F.explode(F.coalesce(*parts)).alias("part"))
        every = cool.unionByName(warm.select(F.xxhash64("tag", "top", "part").alias("node"), "fp", "tag"))
    n = int(codes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return every.repartition(n, "node").sortWithinPartitions("node").mapInArrow(lambda b: star_edges(b, distance, direct), "u long, v long, tag int")


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", shingle: int = 3, distance: int = 3) -> DataFrame:
    """(id, fingerprint hex, component_id): component_id is the smallest id reachable over links, the row's own included."""
    prints = materialize(with_fingerprints(docs, id_column, text_column, shingle), "fingerprints")
    least = prints.groupBy("fp").agg(F.min(id_column).alias("least"))
    roots = components(links(prints.select("fp").distinct(), distance).select("u", "v"))
    # edges order fingerprints, not ids: the smallest id of a component is found afterwards
    placed = least.join(roots, least.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    smallest = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    of = placed.join(smallest, "root").select("fp", "component_id")
    return prints.join(of, "fp").select(id_column, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def jaccard(a: bytes, b: bytes, shingle: int) -> float:
    """Of the sets of word shingles, lower case."""
    (x, y), _ = shingle_hashes([a, b], shingle)
    both = len(np.intersect1d(x, y))
    return both / (len(np.unique(x)) + len(np.unique(y)) - both)


def least_common(n, m, similarity: float):
    """Members that sets of ``n`` and ``m`` members have in common at least, if they are that similar."""
    return F.ceil(similarity / (1 + similarity) * (n + m) - 1e-9)


def first_shingles(texts: list[bytes], shingle: int, similarity: float, common: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Of each text's distinct shingle hashes the first ones, so many that two texts that are that similar share one of them, and how
    many distinct ones it has.  They are in ascending order, those in ``common`` (sorted) after all others."""
    firsts, sizes = [], []
    for text in texts:
        (h,), _ = shingle_hashes([text], shingle)
        h = np.unique(h)
        keep = len(h) - math.ceil(similarity * len(h) - 1e-9) + 1
        if len(common):
            often = common[np.minimum(np.searchsorted(common, h), len(common) - 1)] == h
            h = np.concatenate([h[~often], h[often]])
        firsts.append(h[:keep])
        sizes.append(len(h))
    return firsts, np.array(sizes, np.int32)


def whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """Columns of rows sorted by the first one, cut only where that changes."""
    held: list[np.ndarray] | None = None
    for b in batches:
        now = [c.to_numpy(zero_copy_only=False) for c in b.columns]
        if held:
            now = [np.concatenate(x) for x in zip(held, now)]
        if not len(now[0]):
            continue
        cut = np.searchsorted(now[0], now[0][-1])
        held = [x[cut:].copy() for x in now]
        if cut:
            yield tuple(x[:cut] for x in now)
    if held:
        yield tuple(held)


MET = "h long, a long, b long, x int, y int"


def meetings(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """Rows (h, id, n) sorted by h and id in; out all pairs (a, b, their sizes x, y) that share an h with at most ``FEW`` holders, and
    for an h of more, its rows (h, a, x), each with the id before it (b, y)."""
    for h, i, n in whole_groups(batches):
        start = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
        size = np.diff(np.append(start, len(h)))
        many = np.repeat(size > FEW, size)
        if many.any():
            k = np.flatnonzero(many)
            before = np.where(np.isin(k, start), k, k - 1)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (h[k], i[k], i[before], n[k], n[before])], ["h", "a", "b", "x", "y"])
        for d in range(1, FEW):
            k = np.flatnonzero((h[d:] == h[:-d]) & ~many[d:])
            if not len(k):
                break
            p, q = k, k + d
            k = np.minimum(n[p], n[q]) >= similarity * np.maximum(n[p], n[q]) - 1e-9
            p, q = p[k], q[k]
            yield pa.RecordBatch.from_arrays([pa.nulls(len(p), pa.int64()), pa.array(i[p]), pa.array(i[q]), pa.array(n[p]), pa.array(n[q])], ["h", "a", "b", "x", "y"])


def parity_sketch(h: np.ndarray) -> np.ndarray:
    """Of distinct hashes: each bit says whether an odd number of them falls on it."""
    bits = np.bincount((h & np.uint64(64 * WORDS - 1)).astype(np.int64), minlength=64 * WORDS) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def may_be_alike(differ, n, m, similarity: float):
    """Whether sets of ``n`` and ``m`` members whose sketches differ in so many bits may be that similar."""
    return differ <= n + m - 2 * least_common(n, m, similarity)


def across(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """Rows (h, id, n, root, sketch) sorted by h and id in; out the pairs (a, b, x, y) of one h that have different roots and by their
    sketches may be similar."""
    for h, i, n, root, *words in whole_groups(batches):
        sketch = np.stack(words, axis=1).view(np.uint64)
        start = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
        for s, e in zip(start.tolist(), [*start[1:].tolist(), len(h)]):
            if (root[s:e] == root[s]).all():
                continue
            found: list[tuple[np.ndarray, np.ndarray]] = []
            for at in range(s, e - 1):
                k = at + 1 + np.flatnonzero((root[at + 1 : e] != root[at]) & (np.minimum(n[at + 1 : e], n[at]) >= similarity * np.maximum(n[at + 1 : e], n[at]) - 1e-9))
                both = n[k].astype(np.int64) + n[at]
                k = k[np.bitwise_count(sketch[k] ^ sketch[at]).sum(axis=1) <= both - 2 * np.ceil(similarity / (1 + similarity) * both - 1e-9)]
                if len(k):
                    found.append((np.full(len(k), at), k))
                if found and (at == e - 2 or sum(len(k) for _, k in found) >= FRONTIER):
                    p, q = (np.concatenate(x) for x in zip(*found))
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (i[p], i[q], n[p], n[q])], ["a", "b", "x", "y"])
                    found = []


def similar_documents(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """(id, component_id): component_id is the smallest id reachable over links, the row's own included.

    Texts with the same words in the same order are linked, and all others whose shingles have the Jaccard similarity.  Null and
    empty texts are one group.
    """
    spark = docs.sparkSession
    text = F.regexp_replace(F.translate(F.coalesce(text_column, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", LOWER), SPACES, " ")
    keyed = docs.select(F.col(id_column).alias("_id"), F.trim(text).alias("_text")).withColumn("_key", F.substring(F.unhex(F.sha2(F.col("_text").cast("binary"), 256)), 1, 16))
    rows = materialize(keyed.select("_id", "_key"), "rows")
    # texts meet by a number of 64 bits, and are compared as texts
    texts = materialize(keyed.select("_key", "_text").dropDuplicates(["_key"]).withColumn("n", F.xxhash64("_key")), "texts")
    # an empty text has no word and no similarity: exact copies are all that it is like
    full = texts.where("_text != ''")

    def every(b: pa.RecordBatch) -> pa.RecordBatch:
        hashed, _ = shingle_hashes(b.column(0).cast(pa.binary()).to_pylist(), shingle)
        return pa.RecordBatch.from_arrays([pa.array(joined([np.unique(h) for h in hashed]).view(np.int64))], ["h"])

    # what is common goes last, so that few texts meet by it; that is judged on some texts, as any order leads to the same links
    some = full.where(F.pmod("n", F.lit(SOME)) == 0).select("_text").mapInArrow(per_step(every, "_text"), "h long")
    often = some.groupBy("h").count().where(F.col("count") >= OFTEN).orderBy(F.desc("count"), "h").limit(MOST_COMMON).select("h").toArrow()
    common = spark.sparkContext.broadcast(np.sort(often.column(0).to_numpy().view(np.uint64)))

    def first(b: pa.RecordBatch) -> pa.RecordBatch:
        firsts, sizes = first_shingles(b.column(1).cast(pa.binary()).to_pylist(), shingle, similarity, common.value)
        held = list(map(len, firsts))
        return pa.RecordBatch.from_arrays([pa.array(joined(firsts).view(np.int64)), pa.array(np.repeat(b.column(0).to_numpy(), held)), pa.array(np.repeat(sizes, held))], ["h", "id", "size"])

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    firsts = full.select("n", "_text").mapInArrow(per_step(first, "_text"), "h long, id long, size int")
    met = materialize(firsts.repartition(parts, "h").sortWithinPartitions("h", "id").mapInArrow(lambda b: meetings(b, similarity), MET), "met")
    few, many = met.where("h IS NULL").select("a", "b", "x", "y"), met.where("h IS NOT NULL")

    def check(b: pa.RecordBatch) -> pa.RecordBatch:
        x, y = (b.column(i).cast(pa.binary()).to_pylist() for i in (2, 3))
        return b.select([0, 1]).filter(pa.array([jaccard(p, q, shingle) >= similarity for p, q in zip(x, y)], pa.bool_()))

    def sketch(b: pa.RecordBatch) -> pa.RecordBatch:
        hashed = [np.unique(h) for h in shingle_hashes(b.column(1).cast(pa.binary()).to_pylist(), shingle)[0]]
        bits = np.stack([parity_sketch(h) for h in hashed])
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(list(map(len, hashed)), pa.int32()), *map(pa.array, bits.T)], ["n", "size", *words])

    words = [f"w{j}" for j in range(WORDS)]
    sketches = materialize(full.select("n", "_text").mapInArrow(per_step(sketch, "_text"), ", ".join(["n long, size int", *(f"{w} long" for w in words)])), "sketches")

    def alike(pairs: DataFrame) -> DataFrame:
        """(u, v): keys of the pairs (a, b) that are similar."""
        p, q = (sketches.select(F.col("n").alias(k), *(F.col(c).alias(k + c) for c in ("size", *words))) for k in "ab")
        differ = reduce(lambda x, y: x + y, (F.bit_count(F.col("a" + w).bitwiseXOR(F.col("b" + w))) for w in words))
        pairs = pairs.join(p, "a").join(q, "b").where(may_be_alike(differ, F.col("asize"), F.col("bsize"), similarity))
        pairs = materialize(pairs.select("a", "b"), "pairs")
        needed = pairs.select(F.explode(F.array("a", "b")).alias("n")).distinct()
        held = full.join(needed, "n", "left_semi")
        of = lambda c, k: held.select(F.col("n").alias(c), F.col("_key").alias(k), F.col("_text").alias(f"{c}_text"))
        return materialize(pairs.join(of("a", "u"), "a").join(of("b", "v"), "b").select("u", "v", "a_text", "b_text").mapInArrow(per_step(check, "a_text"), "u binary, v binary"), "alike")

    # texts that share common shingles are compared with one neighbour each and with the first of all: what these links join needs no
    # further pairs.  Then all pairs that they leave apart follow
    near = lambda x, y: F.least(x, y) >= similarity * F.greatest(x, y) - 1e-9
    lead = many.groupBy("h").agg(F.min(F.struct("a", "x")).alias("f")).select("h", F.col("f.a").alias("b"), F.col("f.x").alias("y"))
    stars = many.select("a", "b", "x", "y").unionByName(many.select("h", "a", "x").join(lead, "h").select("a", "b", "x", "y"))
    stars = stars.where((F.col("a") != F.col("b")) & near(F.col("x"), F.col("y"))).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    linked = alike(stars)
    number = lambda k: F.xxhash64(k)
    roots = components(linked.select(number("u").alias("u"), number("v").alias("v")))
    placed = many.select("h", F.col("a").alias("id"), F.col("x").alias("size")).join(roots, F.col("id") == roots.node, "left").select("h", "id", "size", F.coalesce("root", "id").alias("root"))
    placed = placed.join(sketches.select(F.col("n").alias("id"), *words), "id").select("h", "id", "size", "root", *words)
    apart = placed.repartition(parts, "h").sortWithinPartitions("h", "id").mapInArrow(lambda b: across(b, similarity), "a long, b long, x int, y int")
    # of two similar sets, the one whose first ones end first has all that they share but what follows its own
    after = lambda n: F.ceil(similarity * F.col(n) - 1e-9) - 1
    least = least_common(F.col("x"), F.col("y"), similarity) - F.greatest(after("x"), after("y"))
    pairs = few.unionByName(apart).groupBy("a", "b", "x", "y").agg(F.count("*").alias("shared")).where(F.col("shared") >= least).select("a", "b")
    roots = components(linked.unionByName(alike(pairs)))
    placed = rows.join(roots, rows._key == roots.node, "left").select("_id", F.coalesce("root", "_key").alias("root"))
    # smallest ids are pre-aggregated before the shuffle, whatever the size of a group
    smallest = placed.groupBy("root").agg(F.min("_id").alias("component_id"))
    return placed.join(smallest, "root").select(F.col("_id").alias(id_column), "component_id")
