"""Term, entropy and sentence statistics over texts."""

from __future__ import annotations

import hashlib
import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docweave.functions import text as T
from docweave.operators.graphs import parts_for, written


def postings(docs: DataFrame, text: str, by: list[str]) -> DataFrame:
    """(by..., term, tf): aggregated before it is ever joined."""
    return docs.select(*by, F.explode(T.words(F.col(text))).alias("term")).groupBy(*by, "term").agg(F.count("*").alias("tf"))


def frequencies(postings_: DataFrame) -> DataFrame:
    """(term, tf, df) of a corpus."""
    return postings_.groupBy("term").agg(F.sum("tf").alias("tf"), F.count("*").alias("df"))


def smooth_idf(n: Column, df: Column) -> Column:
    return F.log((1 + n) / (1 + df)) + 1


def bm25_idf(n: Column, df: Column) -> Column:
    return F.log((n - df + 0.5) / (df + 0.5) + 1)


def plain_idf(n: Column, df: Column) -> Column:
    return F.when((df > 0) & (n > 0), F.log(n / df)).otherwise(0.0)


def entropy_by(postings_: DataFrame, by: list[str]) -> DataFrame:
    """Entropy (base 2), its maximum, their ratio, tokens and types for each group.

    H = log2(N) - sum(tf log2 tf) / N needs no second pass over a group's total.
    """
    agg = postings_.groupBy(*by).agg(F.sum("tf").alias("tokens"), F.count("*").alias("types"), F.sum(F.col("tf") * F.log2("tf")).alias("s"))
    h = F.greatest(F.lit(0.0), F.log2("tokens") - F.col("s") / F.col("tokens"))
    most = F.log2("types")
    return agg.select(*by, "tokens", "types", h.alias("entropy"), most.alias("max_entropy"), F.when(most > 0, h / most).otherwise(0.0).alias("normalized"))


def top_within(df: DataFrame, by: list[str], k: int, order: list[Column]) -> DataFrame:
    """The first k rows of each group, with their rank; Spark limits each task's rows before it shuffles them."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)


def inverse_frequency(freq: DataFrame) -> DataFrame:
    """1 / (1 + ln(1 + tf)) of each term."""
    return freq.select("term", "tf", (1 / (1 + F.log(1 + F.col("tf")))).alias("weight"))


def capitalised_spans(docs: DataFrame, text: str) -> DataFrame:
    """(entity, n): runs of capitalised ASCII words."""
    spans = F.regexp_extract_all(F.col(text), F.lit(r"([A-Z][a-z]+(?: [A-Z][a-z]+)*)"), F.lit(1))
    return docs.select(F.explode(spans).alias("entity")).groupBy("entity").agg(F.count("*").alias("n"))


def keyphrases(docs: DataFrame, text: str, by: str, k: int) -> DataFrame:
    """Top phrases of each document: words by tf x smooth idf, neighbouring pairs by the product of their counts x 1.5.

    Pairs need a document's own counts only, so its best ones are found in its row.  An idf lies between 1 and that of a word of one
    document, so of the words only those go on to the join with their idf that may still be among the first ``k``.
    """
    kind = dict(docs.dtypes)[by]
    n = docs.count()
    most = math.log((1 + n) / 2) + 1 if n else 1.0
    tokens = docs.select(by, T.without(T.words(F.col(text)), T.STOP_WORDS).alias("w")).where("w IS NOT NULL")
    # rows of one id are one document; only ids that repeat are shuffled with their words
    again = docs.groupBy(by).agg(F.count("*").alias("rows")).where(F.col("rows") > 1).select(by)
    alone = tokens.where(F.col(by).isNotNull()).join(again, by, "left_anti").select(by, F.array("w").alias("w"))
    shared = tokens.join(again, by, "left_semi").unionByName(tokens.where(F.col(by).isNull())).groupBy(by).agg(F.collect_list("w").alias("w"))
    held = alone.unionByName(shared)
    df = held.select(F.explode(F.array_distinct(F.flatten("w"))).alias("phrase")).groupBy("phrase").agg(F.count("*").alias("df"))
    idf = df.select("phrase", smooth_idf(F.lit(n), F.col("df")).alias("idf"))

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 64):
                part = b.slice(at, 64)
                rows, phrases, counts, scores = [], [], [], []
                for i, (key, texts) in enumerate(zip(part.column(0).to_pylist(), part.column(1).to_pylist())):
                    tf = Counter(x for w in texts for x in w)
                    pairs = {(x, y) for w in texts for x, y in zip(w, w[1:])} if key is not None else ()
                    best = heapq.nsmallest(k, ((-tf[x] * tf[y] * 1.5, f"{x} {y}") for x, y in pairs))
                    sure = heapq.nlargest(k, [*(-s for s, _ in best), *map(float, heapq.nlargest(k, tf.values()))])
                    least = sure[-1] - 1e-6 if len(sure) == k else 0.0
                    words = [(x, c) for x, c in tf.items() if c * most >= least]
                    rows += [i] * (len(best) + len(words))
                    phrases += [p for _, p in best] + [x for x, _ in words]
                    counts += [None] * len(best) + [c for _, c in words]
                    scores += [-s for s, _ in best] + [None] * len(words)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(rows, pa.int64())), pa.array(phrases, pa.string()), pa.array(counts, pa.int64()), pa.array(scores, pa.float64())], [by, "phrase", "tf", "score"])

    rows = written(held.mapInArrow(found, f"`{by}` {kind}, phrase string, tf long, score double"), "phrases")
    single = rows.where("tf IS NOT NULL").join(idf, "phrase").select(by, "phrase", (F.col("tf") * F.col("idf")).alias("score"))
    double = rows.where("tf IS NULL").select(by, "phrase", "score")
    return top_within(single.unionByName(double), [by], k, [F.desc(F.round("score", 9)), F.asc("phrase")])


def sentiment(text: Column) -> Column:
    """positive, negative: shares of lexicon words among them; compound: their difference; 0 without any."""
    w = T.words(text)
    count = lambda lexicon: F.size(F.filter(w, lambda x: F.array_contains(F.array(*map(F.lit, lexicon)), x)))
    p, n = count(T.POSITIVE), count(T.NEGATIVE)
    part = lambda x: F.when(p + n > 0, x / (p + n)).otherwise(0.0)
    return F.struct(part(p).alias("positive"), part(n).alias("negative"), part(p - n).alias("compound"))


def exact_groups(docs: DataFrame, by: str, text: str) -> DataFrame:
    """(hash, n, first): texts equal but for case and white space."""
    return docs.select(by, T.normal_hash(F.col(text), 64).alias("hash")).groupBy("hash").agg(F.count("*").alias("n"), F.min(by).alias("first")).where("n > 1")


def first_of_equal(docs: DataFrame, by: str, text: str) -> DataFrame:
    """One row for each normalised text: that of the smallest id.  A minimum is pre-aggregated; a window would not be."""
    return docs.select(by, T.normal_hash(F.col(text), 64).alias("hash")).groupBy("hash").agg(F.min(by).alias(by)).select(by, "hash")


def minhash(tokens: Column, n: int = 64) -> Column:
    """MinHash over 31-bit hashes: (a x + b) mod (2^31 - 1) fits 64-bit numbers, so it needs no Python."""
    prime = (1 << 31) - 1
    a = [(2654435761 * (i + 1)) % prime | 1 for i in range(n)]
    b = [(40503 * (i + 7) * (i + 3)) % prime for i in range(n)]
    h = F.transform(F.array_distinct(tokens), lambda t: F.conv(F.substring(F.md5(t.cast("binary")), 1, 8), 16, 10).cast("long").bitwiseAND(prime))
    pairs = F.array(*(F.struct(F.lit(x).cast("long").alias("a"), F.lit(y).cast("long").alias("b")) for x, y in zip(a, b)))
    # folded over the hashes, which are thus computed once and not once for each permutation
    return F.aggregate(h, F.array_repeat(F.lit(prime).cast("long"), n), lambda least, x: F.zip_with(least, pairs, lambda m, c: F.least(m, (c["a"] * x + c["b"]) % prime)))


def min_signatures(docs: DataFrame, by: str, tokens: Column, n: int) -> DataFrame:
    """(by, signature array<int>): ``minhash`` of each row's words, a batch at a time; rows without words are left out."""
    prime = (1 << 31) - 1
    a = [(2654435761 * (i + 1)) % prime | 1 for i in range(n)]
    b = [(40503 * (i + 7) * (i + 3)) % prime for i in range(n)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                part = part.filter(pc.greater(pc.list_value_length(part.column(1)), 0))
                if not part.num_rows:
                    continue
                words = part.column(1).flatten().dictionary_encode()
                h = np.array([int(hashlib.md5(w.encode()).hexdigest()[:8], 16) & prime for w in words.dictionary.to_pylist()], np.int64)[words.indices.to_numpy()]
                lens = pc.list_value_length(part.column(1)).to_numpy().astype(np.int64)
                start = np.cumsum(lens) - lens
                least = np.stack([np.minimum.reduceat((x * h + y) % prime, start) for x, y in zip(a, b)], axis=1).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, least.size + 1, n, dtype=np.int32)), pa.array(least.ravel()))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], [by, "signature"])

    return docs.select(by, F.array_distinct(tokens).alias("w")).mapInArrow(run, f"`{by}` {dict(docs.dtypes)[by]}, signature array<int>")


#: Members of a band that one task holds against as many others, rows of a task.
MEMBERS, BANDED = 2048, 200_000


def band_pairs(signatures: DataFrame, by: str, bands: int, rows: int) -> DataFrame:
    """(a, b, similarity): all pairs of ids that share a band, smaller first, each once, and the share of equal places.  Rows of equal signatures
    should be one row: see ``signature_classes``.

    Only ids go to the bands at first; those that meet another take their signature along, so no pair is shuffled: a task that sees both
    signatures gives the pair in the first band that it shares.  Bands of over MEMBERS are dealt to tasks by pairs of their parts.
    """
    kind = dict(signatures.dtypes)[by]
    keys = signatures.select(by, F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda i: F.xxhash64(i, F.slice("signature", i * rows + 1, F.lit(rows))))).alias("band", "h"))
    met = written(keys.withColumn("n", F.count("*").over(Window.partitionBy("band", "h"))).where("n > 1").withColumn("parts", F.ceil(F.col("n") / MEMBERS)), "met")
    size = met.agg(F.sum("parts")).first()[0] or 0
    held = met.withColumn("own", F.pmod(F.xxhash64(by), "parts")).join(signatures, by)
    held = held.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    cell = ["band", "h", "i", "j"]
    held = held.select(F.col(by).alias("id"), "signature", "band", "h", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own")

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs(t: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            ids, band, own = (t.column(c).to_numpy(zero_copy_only=False) for c in (0, 2, 6))
            s = t.column(1).flatten().to_numpy().reshape(t.num_rows, -1)
            key = cell_numbers(t)
            across = t.column(4).to_numpy() != t.column(5).to_numpy()
            at, out, n = np.arange(t.num_rows), [], 0
            for step in range(1, t.num_rows):
                at = at[at + step < t.num_rows]
                at = at[key[at] == key[at + step]]
                if not len(at):
                    break
                x = at[~across[at] | (own[at] != own[at + step])]
                y = x + step
                equal = s[x] == s[y]
                shared = equal[:, : bands * rows].reshape(len(x), bands, rows).all(axis=2)
                keep = shared.any(axis=1) & (shared.argmax(axis=1) == band[x])
                x, y, similar = x[keep], y[keep], equal[keep].mean(axis=1)
                first = ids[x] < ids[y]
                out.append((np.where(first, x, y), np.where(first, y, x), similar))
                n += len(x)
                if n > 1 << 16:
                    yield found(t, out)
                    out, n = [], 0
            if n:
                yield found(t, out)

        def found(t: pa.RecordBatch, out: list[tuple]) -> pa.RecordBatch:
            a, b, similar = (np.concatenate(x) for x in zip(*out))
            return pa.RecordBatch.from_arrays([t.column(0).take(pa.array(a)), t.column(0).take(pa.array(b)), pa.array(similar)], ["a", "b", "similarity"])

        def cell_numbers(t: pa.RecordBatch) -> np.ndarray:
            c = np.stack([t.column(k).to_numpy().astype(np.int64) for k in (2, 3, 4, 5)])
            return np.cumsum(np.concatenate([[0], (c[:, 1:] != c[:, :-1]).any(axis=0)]))

        left: list[pa.RecordBatch] = []  # the last cell so far; it may go on
        for batch in batches:
            if not batch.num_rows:
                continue
            left.append(batch)
            if sum(x.num_rows for x in left) < 4 * MEMBERS:
                continue
            t = pa.Table.from_batches(left).combine_chunks().to_batches()[0]
            last = int(np.searchsorted(number := cell_numbers(t), number[-1]))
            if last:
                yield from pairs(t.slice(0, last))
            left = [t.slice(last)]
        if left:
            yield from pairs(pa.Table.from_batches(left).combine_chunks().to_batches()[0])

    dealt = held.repartition(parts_for(signatures.sparkSession, size, BANDED), *cell).sortWithinPartitions(*cell)
    return dealt.mapInArrow(compared, f"a {kind}, b {kind}, similarity double")


def signature_classes(signatures: DataFrame, by: str) -> DataFrame:
    """(by, signature, n): each distinct signature once, under its smallest id, and its number of rows."""
    return signatures.groupBy("signature").agg(F.min(by).alias(by), F.count("*").alias("n")).select(by, "signature", "n")


#: Dimensions that the commonest members of two blocks have to themselves, cells of one dense strip, sets of one strip at most.
OWN, CELLS, STRIP = 512, 1 << 22, 2048
#: Weight of a block of sets at least and at most (a set weighs the root of its size), blocks' pairs for each core.
LIGHT, HEAVY, PAIRS_EACH = 20_000, 500_000, 8


def size_blocks(sizes: list[tuple[int, int]], most: int) -> tuple[list[tuple[int, float, float]], list[tuple[int, int]]]:
    """Sets in order of size are cut into blocks of equal weight, ``most`` of them unless they grow too heavy.

    sizes: (n, sets), ascending.  Gives (n, start, width) in widths of a block, and the smallest and largest size in each block.
    """
    weights = [c * math.sqrt(256 + n) for n, c in sizes]
    total = math.fsum(weights)
    each = total / max(min(most, math.ceil(total / LIGHT)), math.ceil(total / HEAVY), 1)
    last = max(0, round(total / each) - 1)
    places, ends, at = [], {}, 0.0
    for (n, _), w in zip(sizes, weights):
        places.append((n, at / each, w / each))
        for k in range(min(last, int(at / each)), min(last, int((at + w) / each)) + 1):
            ends[k] = (ends.get(k, (n,))[0], n)
        at += w
    return places, [ends[k] for k in range(last + 1)]


def meeting_sets(sets: DataFrame, least: float) -> DataFrame:
    """(a, b): all pairs of sets (id, w) whose Jaccard similarity is ``least`` or more, and hardly any other, the smaller id first.  With a column
    ``side`` (0 or 1), ids of which are told apart by side, the pairs of a set of side 0 and one of side 1.

    Sets in order of size are cut into blocks; a task holds two blocks whose sizes allow the similarity, as numbers of 32 bits, however large the
    table is.  In it, strips of sets become matrices of counts, in which the commonest members have columns of their own and the rest share
    some; one product bounds what all pairs of two strips have in common from above, and pairs that may be similar are counted again
    member by member.  Equal numbers of different members, like shared columns, add to what is in common, so no pair is lost.  The work is that of all pairs of similar size.
    """
    if not 0 < least < 1:
        raise ValueError("least lies between 0 and 1")
    spark, one_side = sets.sparkSession, "side" not in sets.columns
    kind = dict(sets.dtypes)["id"]
    rows = sets.where("size(w) > 0").select("id", (F.lit(0) if one_side else F.col("side").cast("int")).alias("side"), F.size("w").alias("n"), F.transform("w", lambda x: F.hash(x)).alias("h"))
    found: dict[int, list[tuple[int, int]]] = {0: [], 1: []}
    for r in rows.groupBy("side", "n").agg(F.count("*").alias("c")).orderBy("side", "n").collect():
        found[r.side].append((r.n, r.c))
    if not found[0] or not (one_side or found[1]):
        return sets.select(F.col("id").alias("a"), F.col("id").alias("b")).limit(0)
    # about a half of the pairs of blocks differ too much in size, a half of the rest is the same the other way round
    wanted = PAIRS_EACH * max(8, spark.sparkContext.defaultParallelism)
    most = math.ceil(math.sqrt((4 if one_side else 2) * wanted))
    blocks = {s: size_blocks(c, most) for s, c in found.items() if c}
    left, right = blocks[0][1], blocks[0 if one_side else 1][1]
    pairs = [(i, j) for i, x in enumerate(left) for j, y in enumerate(right) if (i <= j or not one_side) and least * y[0] <= x[1] and least * x[0] <= y[1]]
    if not pairs:
        return sets.select(F.col("id").alias("a"), F.col("id").alias("b")).limit(0)
    roles = [(0, i, p, False) for p, (i, _) in enumerate(pairs)] + [(0 if one_side else 1, j, p, True) for p, (i, j) in enumerate(pairs) if not (one_side and i == j)]
    places = spark.createDataFrame([(s, n, start, width, len(b)) for s, (at, b) in blocks.items() for n, start, width in at], "side int, n int, start double, width double, blocks int")
    roles = spark.createDataFrame(roles, "side int, block int, pair int, right boolean")
    within = F.pmod(F.xxhash64("id"), F.lit(1 << 20)) / F.lit(1 << 20)
    block = F.least(F.floor(F.col("start") + F.col("width") * within).cast("int"), F.col("blocks") - 1)
    dealt = rows.join(F.broadcast(places), ["side", "n"]).select("side", block.alias("block"), "id", "n", "h").join(F.broadcast(roles), ["side", "block"])
    dealt = dealt.select("pair", "right", "id", "n", "h").repartitionById(len(pairs), F.col("pair"))
    share, bits = least / (1 + least), (1 << 20) - 1

    class Sets:
        """Sets in order of size: ids, sizes, members one after another, and strips of them."""

        def __init__(self, t: pa.Table):
            t = t.combine_chunks().sort_by("n").combine_chunks()
            self.ids, self.n = t.column("id"), t.column("n").to_numpy().astype(np.int64)
            members = np.concatenate([np.zeros(0, np.uint32), *(c.flatten().to_numpy().view(np.uint32) for c in t.column("h").chunks)])
            # a set's members ascend
            self.members = np.sort((np.repeat(np.arange(len(self.n)), self.n) << 32) | members).astype(np.uint32)
            self.start = np.concatenate(([0], np.cumsum(self.n)))
            self.strips, at = [], 0
            while at < len(self.n):
                stop = min(len(self.n), at + STRIP)
                while stop > at + 1 and (stop - at) * (OWN + self.n[stop - 1] / least) > CELLS:
                    stop = at + (stop - at) // 2
                self.strips.append((at, stop))
                at = stop

        def counts(self, strip: tuple[int, int], own: np.ndarray, wide: int, first: bool) -> np.ndarray:
            """Counts by column; the last two columns make a product fall by the least number in common."""
            at, stop = strip
            n, h = self.n[at:stop], self.members[self.start[at] : self.start[stop]]
            column = own[h & bits]
            column = np.where(column >= 0, column, OWN + (h >> np.uint32(7)) % np.uint32(wide))
            cells = np.bincount(np.repeat(np.arange(stop - at), n) * (OWN + wide) + column, minlength=(stop - at) * (OWN + wide))
            out = np.empty((stop - at, OWN + wide + 2), np.float32)
            out[:, :-2] = cells.reshape(stop - at, -1)
            out[:, -2], out[:, -1] = (-share * n, -share) if first else (1, n)
            return out

    def crossed(t: pa.Table) -> Iterator[pa.RecordBatch]:
        x = Sets(t.filter(pc.invert(t.column("right"))))
        alike = not pc.any(t.column("right")).as_py()
        y = x if alike else Sets(t.filter(t.column("right")))
        often = np.bincount(x.members & bits, minlength=bits + 1)
        if not alike:
            often += np.bincount(y.members & bits, minlength=bits + 1)
        own = np.full(bits + 1, -1, np.int64)
        own[np.argpartition(often, -OWN)[-OWN:]] = np.arange(OWN)
        for i, p in enumerate(x.strips):
            made: dict[int, np.ndarray] = {}
            for q in y.strips[i if alike else 0 :]:
                if least * y.n[q[0]] > x.n[p[1] - 1] or least * x.n[p[0]] > y.n[q[1] - 1]:
                    continue
                wide = 256 * math.ceil(math.sqrt(x.n[p[1] - 1] * y.n[q[1] - 1]) / least / 256)
                if wide not in made:
                    made = {wide: x.counts(p, own, wide, True)}
                product = made[wide] @ y.counts(q, own, wide, False).T
                # half a member is more than single precision errs by
                a, b = np.nonzero(product > -0.5)
                if p == q and alike:
                    a, b = a[a < b], b[a < b]
                if len(a):
                    yield from similar(x, y, p[0] + a, q, b)

    def similar(x: Sets, y: Sets, a: np.ndarray, strip: tuple[int, int], b: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Of the pairs of set a of x and the b-th set of a strip of y, those that have enough members in common."""
        at, stop = strip
        held = (np.repeat(np.arange(stop - at), y.n[at:stop]) << 32) | y.members[y.start[at] : y.start[stop]]
        upto = np.cumsum(x.n[a])
        done = 0
        while done < len(a):
            end = max(done + 1, int(np.searchsorted(upto, (upto[done - 1] if done else 0) + CELLS, "right")))
            n, u, v = x.n[a[done:end]], a[done:end], b[done:end]
            begin = np.cumsum(n) - n
            asked = (np.repeat(v, n) << 32) | x.members[np.repeat(x.start[u] - begin, n) + np.arange(n.sum())]
            hit = held[np.minimum(np.searchsorted(held, asked), len(held) - 1)] == asked
            keep = np.add.reduceat(hit, begin, dtype=np.int64) >= share * (n + y.n[at + v]) - 1e-6
            if keep.any():
                yield from pa.table({"a": x.ids.take(pa.array(u[keep])), "b": y.ids.take(pa.array(at + v[keep]))}).combine_chunks().to_batches()
            done = end

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)  # one pair of blocks lies in a partition
        if held:
            yield from crossed(pa.Table.from_batches(held))

    met = dealt.mapInArrow(compared, f"a {kind}, b {kind}")
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")) if one_side else met


def similar_sets(docs: DataFrame, by: str, tokens: Column, least: float) -> DataFrame:
    """(a, b, jaccard): every pair of different sets of that similarity, between the smallest ids of equal sets, and each other id of
    equal sets with the smallest (1.0).  Empty sets are left out.

    Sets are compared in blocks (``meeting_sets``), which loses no pair; equal sets count once, so copies are not paired with one another.
    """
    rows = docs.select(F.col(by).alias("id"), F.array_sort(F.array_distinct(tokens)).alias("w")).where("size(w) > 0").withColumn("key", F.sha2(F.array_join("w", "\x01").cast("binary"), 256))
    first = written(rows.groupBy("key").agg(F.min(F.struct("id", "w")).alias("m")).select("key", "m.id", "m.w"), "sets")
    members = rows.select("id", "key").join(first.select("key", F.col("id").alias("a")), "key").where("id != a").select("a", F.col("id").alias("b"), F.lit(1.0).alias("jaccard"))
    met = written(meeting_sets(first.select("id", "w"), least), "met")
    x, y = (first.select(F.col("id").alias(i), F.col("w").alias(w)) for i, w in (("a", "x"), ("b", "y")))
    both = met.join(x, "a").join(y, "b").select("a", "b", F.size(F.array_intersect("x", "y")).alias("both"), (F.size("x") + F.size("y")).alias("sum"))
    scored = both.select("a", "b", (F.col("both") / (F.col("sum") - F.col("both"))).alias("jaccard"))
    return scored.where(F.col("jaccard") >= least).unionByName(members)
