"""Sequential or algebraic kernels over bounded groups, and the relational operators around them."""

from __future__ import annotations

import math

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from docweave.functions import vectors as V
from docweave.operators.graphs import parts_for, written
from docweave.operators.tables import average_ranks

#: Blocks at least, vectors of a block about at most, and rows of a block that are multiplied at once.
BLOCKS, BLOCK, STRIP = 8, 16384, 64
#: Pairs of nodes that one task counts, about.
PAIRS = 1 << 21


def chunks(elements: DataFrame, by: str, budget: int, protected: list[str]) -> DataFrame:
    """(by, chunk, first, last, tokens): runs of elements; a protected type stands alone, and a chunk ends before its budget is
    exceeded.  The budget starts anew with each chunk, so a document is folded in order."""
    kind = dict(elements.dtypes)[by]
    row = F.struct("seq", F.coalesce(F.col("type").isin(protected), F.lit(False)).alias("alone"), "tokens")
    held = elements.groupBy(by).agg(F.array_sort(F.collect_list(row)).alias("rows"))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(1)
            at, rows = lists.offsets.to_pylist(), lists.flatten()
            base = at[0]
            seq, alone, tokens = (rows.field(c).to_pylist() for c in ("seq", "alone", "tokens"))
            of, chunk, first, last, size = [], [], [], [], []
            for i in range(b.num_rows):
                ended, number = True, -1
                for k in range(at[i] - base, at[i + 1] - base):
                    if ended or alone[k] or size[-1] + tokens[k] > budget:
                        number += 1
                        of.append(i)
                        chunk.append(number)
                        first.append(seq[k])
                        last.append(seq[k])
                        size.append(tokens[k])
                    else:
                        last[-1], size[-1] = seq[k], size[-1] + tokens[k]
                    ended = alone[k]
            numbers = [pa.array(chunk, pa.int32()), *(pa.array(c, pa.int64()) for c in (first, last, size))]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(of, pa.int64())), *numbers], [by, "chunk", "first", "last", "tokens"])

    return held.mapInArrow(fold, f"`{by}` {kind}, chunk int, first long, last long, tokens long")


def text_rank(sentences: DataFrame, by: str, rounds: int = 50, damping: float = 0.85) -> DataFrame:
    """(by, i, score) of a text's sentences by shared words; a text is one group.

    Similarity is shared distinct words over the sum of logarithms of the counts; a sentence linked to none gets the base score.
    """
    kind = dict(sentences.dtypes)[by]
    held = sentences.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("i", "words"))).alias("s"))

    def rank(count: int, of: np.ndarray, ids: np.ndarray) -> np.ndarray:
        m = np.zeros((count, max(1, int(ids.max(initial=-1)) + 1)))
        m[of, ids] = 1
        n = np.log(np.maximum(m.sum(1), 1) + 1)
        sim = (m @ m.T) / (n[:, None] + n[None, :])
        np.fill_diagonal(sim, 0)
        total = sim.sum(1, keepdims=True)
        step = np.divide(sim, total, out=np.zeros_like(sim), where=total > 0)
        score = np.full(count, 1 / count)
        for _ in range(rounds):
            score = (1 - damping) / count + damping * step.T @ score
        return score

    def ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in range(b.num_rows):
                s = b.column(1).slice(row, 1).flatten()
                words = s.field("words")
                codes = words.flatten().dictionary_encode().indices.to_numpy()
                score = rank(len(s), np.repeat(np.arange(len(s)), np.diff(words.offsets.to_numpy())), codes)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(np.full(len(s), row))), s.field("i"), pa.array(score)], [by, "i", "score"])

    return held.mapInArrow(ranked, f"`{by}` {kind}, i int, score double")


def co_members(incidence: DataFrame, edge: str, node: str) -> DataFrame:
    """(a, b, shared): nodes that share hyperedges, a < b.

    Tasks are as many as their pairs ask for, and an edge of many nodes is dealt to several, so none counts over about twice ``PAIRS``.
    """
    members = written(incidence.where(F.col(edge).isNotNull() & F.col(node).isNotNull()).select(edge, node), "members")
    sizes = members.groupBy(edge).agg((F.count("*").cast("double") * F.count("*") / 2).alias("met"))
    shares = written(sizes.select(edge, F.ceil(F.col("met") / PAIRS).cast("int").alias("shares"), "met"), "sizes")
    n = parts_for(incidence.sparkSession, shares.agg(F.sum("met")).first()[0] or 0, PAIRS)
    both = written(members.join(shares.select(edge, "shares"), edge), "dealt")
    a = both.select(edge, F.pmod(F.xxhash64(node), F.col("shares")).cast("int").alias("share"), F.col(node).alias("a"))
    b = both.select(edge, F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), F.col(node).alias("b"))
    met = a.repartition(n, edge, "share").join(b.repartition(n, edge, "share"), [edge, "share"]).where("a < b")
    return met.groupBy("a", "b").agg(F.count("*").alias("shared"))


def signed_ranks(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """(n, w_plus, w_minus, z): Wilcoxon's sums over non-zero differences, ties sharing ranks, and the normal deviate.

    The variance is taken in doubles: n cubed leaves a long from 1.7 million rows on.
    """
    d = pairs.select((F.col(a) - F.col(b)).alias("d")).where("d != 0").withColumn("size", F.abs("d"))
    ranked = d.join(average_ranks(d, "size").withColumnRenamed("value", "size"), "size")
    s = ranked.agg(F.count("*").alias("n"), F.sum(F.when(F.col("d") > 0, F.col("rank")).otherwise(0.0)).alias("w_plus"), F.sum(F.when(F.col("d") < 0, F.col("rank")).otherwise(0.0)).alias("w_minus"))
    n = F.col("n").cast("double")
    return s.withColumn("z", (F.col("w_plus") - n * (n + 1) / 4) / F.sqrt(n * (n + 1) * (2 * n + 1) / 24))


@F.pandas_udf(DoubleType())
def two_sided_p(z: pd.Series) -> pd.Series:
    """Of a normal deviate."""
    return z.map(lambda x: math.erfc(abs(x) / math.sqrt(2)), na_action="ignore")


def gram(vectors: DataFrame, vector: str) -> DataFrame:
    """(i, j, value): sums of products of coordinates, i <= j; one pass, aggregated before the shuffle."""
    e = vectors.select(F.posexplode(vector).alias("i", "x"), F.col(vector).alias("v"))
    return e.select("i", "x", F.posexplode("v").alias("j", "y")).where("i <= j").groupBy("i", "j").agg(F.sum(F.col("x").cast("double") * F.col("y").cast("double")).alias("value"))


def singular_values(vectors: DataFrame, vector: str, k: int) -> DataFrame:
    """(i, value): the greatest singular values of the table of vectors, from its Gram matrix (dimensions squared in size)."""

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        n = int(pdf["j"].max()) + 1
        g = np.zeros((n, n))
        g[pdf["i"], pdf["j"]] = g[pdf["j"], pdf["i"]] = pdf["value"]
        values = np.sqrt(np.maximum(np.linalg.eigvalsh(g)[::-1][:k], 0))
        return pd.DataFrame({"i": np.arange(len(values), dtype=np.int32), "value": values})

    return gram(vectors, vector).groupBy().applyInPandas(solve, "i int, value double")


def cache_trace(accesses: DataFrame, by: str, order: list[str], item: str, capacity: int) -> DataFrame:
    """(by, accesses, hits) of a least-recently-used cache for each trace; a trace is folded in order."""
    from collections import OrderedDict

    kind = dict(accesses.dtypes)[by]

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        cache: OrderedDict = OrderedDict()
        hits = 0
        for x in pdf.sort_values(order)[item]:
            if x in cache:
                hits += 1
                cache.move_to_end(x)
            else:
                cache[x] = True
                if len(cache) > capacity:
                    cache.popitem(last=False)
        return pd.DataFrame({by: [pdf[by].iloc[0]], "accesses": [len(pdf)], "hits": [hits]})

    return accesses.groupBy(by).applyInPandas(fold, f"{by} {kind}, accesses long, hits long")


def stationary(transitions: DataFrame, a: str, b: str, p: str, rounds: int = 100) -> DataFrame:
    """(state, share) by power iteration over a chain's states, which are few."""

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        names = sorted(set(pdf[a]) | set(pdf[b]))
        m = np.zeros((len(names), len(names)))
        for x, y, v in zip(pdf[a], pdf[b], pdf[p]):
            m[names.index(x), names.index(y)] = v
        m /= np.maximum(m.sum(1, keepdims=True), 1e-12)
        s = np.full(len(names), 1 / len(names))
        for _ in range(rounds):
            s = s @ m
        return pd.DataFrame({"state": names, "share": s / s.sum()})

    return transitions.groupBy().applyInPandas(solve, "state string, share double")


def betti(points: DataFrame, by: list[str], key: str, near: Column) -> DataFrame:
    """(by..., vertices, edges, parts, loops): of a proximity graph within each group; loops = edges - vertices + parts.

    ``near`` relates columns prefixed a_ and b_.
    """
    cols = [*by, key, "x", "y"]
    a, b = (points.select(*(F.col(c).alias(p + c) for c in cols)) for p in ("a_", "b_"))
    same = [F.col(f"a_{c}") == F.col(f"b_{c}") for c in by]
    e = a.join(b, same).where((F.col(f"a_{key}") < F.col(f"b_{key}")) & near).select(*(F.col(f"a_{c}").alias(c) for c in by), F.col(f"a_{key}").alias("s"), F.col(f"b_{key}").alias("t"))
    kinds = ", ".join(f"{c} {dict(points.dtypes)[c]}" for c in by)
    links = e.groupBy(*by).agg(F.collect_list(F.struct("s", "t")).alias("e"))
    nodes = points.groupBy(*by).agg(F.array_sort(F.collect_list(key)).alias("v"))

    def count(batches):
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                up = {v: v for v in r.v}

                def find(x, up=up):
                    while up[x] != x:
                        x = up[x]
                    return x

                pairs = [] if r.e is None else list(r.e)
                for q in pairs:
                    up[find(q["s"])] = find(q["t"])
                parts = len({find(v) for v in r.v})
                rows.append((*(getattr(r, c) for c in by), len(r.v), len(pairs), parts, len(pairs) - len(r.v) + parts))
            yield pd.DataFrame(rows, columns=[*by, "vertices", "edges", "parts", "loops"])

    return nodes.join(links, by, "left").mapInPandas(count, f"{kinds}, vertices long, edges long, parts long, loops long")


def linked(x: np.ndarray, y: np.ndarray | None, threshold: float) -> np.ndarray:
    """Labels of the rows of x, then of y (or x against itself): the smallest position that cosines of ``threshold`` or more lead to."""
    other = x if y is None else y
    base = 0 if y is None else len(x)
    label = np.arange(base + len(other))
    nx, ny = np.sqrt((x * x).sum(1)), np.sqrt((other * other).sum(1))
    for i in range(0, len(x), STRIP):
        a, b = np.nonzero(x[i : i + STRIP] @ other.T / (nx[i : i + STRIP, None] * ny[None, :]) >= threshold)
        a, b = a + i, b + base
        while (differ := (p := label[a]) != (q := label[b])).any():
            np.minimum.at(label, np.maximum(p, q)[differ], np.minimum(p, q)[differ])
            while (label != (up := label[label])).any():
                label = up
    return label


def cosine_links(vectors: DataFrame, key: str, vector: str, threshold: float) -> DataFrame:
    """(src, dst): edges along which exactly those vectors reach one another that all pairs of cosine ``threshold`` or more join.

    All pairs are compared, block by block, as matrix products, so work grows with the square of the table.  A pair of blocks gives
    a forest, never all its pairs: vectors x blocks edges at most.  Equal vectors are compared once.  Null ids, zero vectors, and vectors with nulls or NaN
    link to nothing, nor do vectors of unequal length.  ``threshold`` is over 0.
    """
    kind = dict(vectors.dtypes)[key]
    length = V.norm(F.col(vector))
    v = vectors.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("x")).where(F.col("id").isNotNull() & (length > 0) & ~F.isnan(length))
    least = written(v.groupBy("x").agg(F.min("id").alias("first")), "vectors")
    equal = v.join(least, "x").where("id != first").select(F.col("first").alias("src"), F.col("id").alias("dst"))
    n = max(BLOCKS, -(-least.count() // BLOCK))
    row = F.struct(F.col("first").alias("id"), "x")
    blocks = written(least.groupBy(F.size("x").alias("width"), F.pmod(F.xxhash64("x"), F.lit(n)).alias("block")).agg(F.collect_list(row).alias("rows")), "blocks")
    spark = vectors.sparkSession
    a, b = (blocks.select("width", F.col("block").alias(k), F.col("rows").alias(f"{k}_rows")) for k in ("lo", "hi"))
    places = blocks.select("width", F.col("block").alias("lo"))
    pairs = places.join(places.withColumnRenamed("lo", "hi"), "width").where("lo <= hi")
    tasks = min(n * (n + 1) // 2, max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    met = pairs.repartition(tasks).join(a, ["width", "lo"]).join(b, ["width", "hi"]).select("lo", "hi", "lo_rows", "hi_rows")

    def matrix(rows: pa.ListArray, i: int) -> tuple[pa.Array, np.ndarray]:
        s = rows.slice(i, 1).flatten()
        return s.field("id"), s.field("x").flatten().to_numpy().reshape(len(s), -1)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, x = matrix(batch.column(2), i)
                y = None
                if batch.column(0)[i] != batch.column(1)[i]:
                    more, y = matrix(batch.column(3), i)
                    ids = pa.concat_arrays([ids, more])
                label = linked(x, y, threshold)
                k = np.flatnonzero(label != np.arange(len(label)))
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(label[k])), ids.take(pa.array(k))], ["src", "dst"])

    return written(equal.unionByName(met.mapInArrow(compare, f"src {kind}, dst {kind}")), "links")
