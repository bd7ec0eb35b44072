"""Scored retrieval: every search yields (item_id, score), which fusion takes as (method, item_id, score)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.functions import text as T
from docweave.functions import vectors as V
from docweave.operators.graphs import written
from docweave.operators.text_stats import bm25_idf, plain_idf


def top(scored: DataFrame, k: int, key: str = "item_id", digits: int = 9) -> DataFrame:
    """The k best by score, ties to the smaller key."""
    return scored.orderBy(F.desc(F.round("score", digits)), key).limit(k)


def query_terms(query: str) -> list[tuple[str, int]]:
    """Words of a query with how often each occurs."""
    import re
    from collections import Counter

    return sorted(Counter(re.findall(r"\w+", query.lower())).items())


def lexical(docs: DataFrame, query: str, key: str = "doc_id", text: str = "text", kind: str = "bm25", k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """(item_id, score, matched): BM25 or tf x ln(N / df) over words; a query word that occurs twice counts twice.

    Only the query's words are counted in each text, so no posting list is built or shuffled.  Texts are cut into words once: the
    counts are written, a few numbers a row, and both the statistics and the scores are taken from them.
    """
    terms = query_terms(query)
    listed = F.array(*(F.lit(t) for t, _ in terms)) if terms else F.array().cast("array<string>")
    w = docs.select(F.col(key).alias("item_id"), T.words(F.col(text)).alias("w"))
    counted = w.select("item_id", F.size("w").alias("len"), F.filter("w", lambda x: F.array_contains(listed, x)).alias("hits"))
    tf = lambda t: F.size(F.filter("hits", lambda x: x == t))
    wide = written(counted.select("item_id", "len", *(tf(t).alias(f"tf{i}") for i, (t, _) in enumerate(terms))), "counts")
    stats = wide.agg(F.count("*").alias("n"), F.avg("len").alias("mean"), *(F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(terms)))).first()
    score: Column = F.lit(0.0)
    for i, (_, times) in enumerate(terms):
        f = F.col(f"tf{i}")
        if kind == "bm25":
            part = bm25_idf(F.lit(stats.n), F.lit(stats[f"df{i}"])) * f * (k1 + 1) / (f + k1 * (1 - b + b * F.col("len") / F.lit(stats["mean"] or 1.0)))
        else:
            part = f * plain_idf(F.lit(stats.n), F.lit(stats[f"df{i}"]))
        score = score + times * F.when(f > 0, part).otherwise(0.0)
    matched = F.filter(F.array(*(F.when(F.col(f"tf{i}") > 0, F.lit(t)) for i, (t, _) in enumerate(terms))), lambda x: x.isNotNull()) if terms else F.array().cast("array<string>")
    return wide.select("item_id", score.alias("score"), matched.alias("matched")).where("size(matched) > 0")


MEASURES: dict[str, Callable[[Column, Column], Column]] = {
    "cosine": V.cosine,
    "dot": V.dot,
    "l2": lambda a, b: -V.l2(a, b),
    "l1": lambda a, b: -V.l1(a, b),
    "linf": lambda a, b: -V.l_inf(a, b),
}


def dense(vectors: DataFrame, query: list[float], measure: str = "cosine", key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(item_id, score) of every vector against one."""
    q = F.array(*(F.lit(float(x)) for x in query))
    return vectors.select(F.col(key).alias("item_id"), MEASURES[measure](F.col(vector), q).alias("score"))


def vector_of(vectors: DataFrame, key: str, vector: str, of: int | None = None) -> list[float]:
    """One stored vector: that of an id, or of the smallest."""
    whole = vectors.where(F.col(key).isNotNull() & F.col(vector).isNotNull())
    row = whole.where(F.col(key) == of).select(vector).first() if of is not None else whole.orderBy(key).select(vector).first()
    return [float(x) for x in row[0]] if row else []


def radius(vectors: DataFrame, query: list[float], r: float, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(item_id, distance) within r."""
    return dense(vectors, query, "l2", key, vector).select("item_id", (-F.col("score")).alias("distance")).where(F.col("distance") <= r)


def in_box(vectors: DataFrame, low: list[float], high: list[float], key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Ids whose first coordinates lie in a box."""
    inside = F.lit(True)
    for i, (a, b) in enumerate(zip(low, high)):
        inside = inside & F.get(F.col(vector), F.lit(i)).between(a, b)
    return vectors.where(inside).select(F.col(key).alias("item_id"))


def centroids(vectors: DataFrame, by: str, vector: str = "embedding") -> DataFrame:
    """(by, pos, mean): the mean of each coordinate within each group."""
    return vectors.select(by, F.posexplode(vector).alias("pos", "x")).groupBy(by, "pos").agg(F.avg("x").alias("mean"))


def maximal_marginal(scored: DataFrame, k: int, weight: float = 0.7, key: str = "item_id", vector: str = "vector") -> DataFrame:
    """(item_id, pick): greedy picks of the best weight x score - (1 - weight) x greatest similarity to earlier picks.

    ``scored`` is a bounded candidate list (a top-n); the greedy choice is sequential, so it runs in one Arrow group.
    """
    import numpy as np
    import pandas as pd

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["score", key], ascending=[False, True]).reset_index(drop=True)
        v = np.stack(pdf[vector].to_numpy()).astype(float)
        v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
        left, chosen, near = list(range(len(pdf))), [], np.zeros(len(pdf))
        while left and len(chosen) < k:
            gain = pdf["score"].to_numpy()[left] if not chosen else weight * pdf["score"].to_numpy()[left] - (1 - weight) * near[left]
            best = left[int(np.argmax(gain))]
            chosen.append(best)
            left.remove(best)
            near = v @ v[best] if len(chosen) == 1 else np.maximum(near, v @ v[best])
        return pd.DataFrame({key: pdf[key].to_numpy()[chosen], "pick": np.arange(1, len(chosen) + 1, dtype=np.int32)})

    return scored.groupBy().applyInPandas(pick, f"{key} long, pick int")


#: Distances that a task holds at once.
HELD = 1 << 22


def near_lists(vectors: DataFrame, lists: DataFrame) -> DataFrame:
    """(item_id, list, dist) of vectors (item_id, v) and the lists (list, cv) that may be nearest to each, the nearest among them.

    Both hold vectors of one length, of finite doubles; lists are few and go to every task.  Products of matrices leave the lists
    whose distance may round to the least; these distances are then taken coordinate by coordinate.
    """
    import numpy as np
    import pyarrow as pa

    found = lists.toArrow()
    kind = dict(vectors.dtypes)["item_id"]
    c = found.column("cv").combine_chunks().flatten().to_numpy().reshape(found.num_rows, -1)
    held = vectors.sparkSession.sparkContext.broadcast((found.column("list").combine_chunks(), c, (c * c).sum(1)))

    def assign(batches):
        names, c, cc = held.value
        step = max(1, HELD // len(c))
        for b in batches:
            every = b.column(1).flatten().to_numpy().reshape(b.num_rows, -1)
            for at in range(0, len(every), step):
                x = every[at : at + step]
                xx = (x * x).sum(1)
                square = xx[:, None] + cc[None, :] - 2 * (x @ c.T)
                i, j = np.nonzero(square <= square.min(1, keepdims=True) + 1e-8 * (1 + xx[:, None] + cc[None, :]))
                total = np.zeros(len(i))
                for k in range(x.shape[1]):
                    total += (x[i, k] - c[j, k]) ** 2
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(i + at)), names.take(pa.array(j)), pa.array(np.sqrt(total))], ["item_id", "list", "dist"])

    return vectors.select("item_id", "v").mapInArrow(assign, f"item_id {kind}, list {dict(lists.dtypes)['list']}, dist double")


def near_cosines(vectors: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """(qid, item_id, score) of queries (qid, qv) and vectors (item_id, v) of other ids: the k greatest cosines among them.

    Both hold vectors of one length, of finite doubles; queries are few and go to every task.  Products of matrices leave, in each
    batch of vectors, those that may be among the k; their cosines are then taken coordinate by coordinate, 0 for zero vectors.
    """
    import numpy as np
    import pyarrow as pa

    found = asked.toArrow()
    q = found.column("qv").combine_chunks().flatten().to_numpy().reshape(found.num_rows, -1)
    held = vectors.sparkSession.sparkContext.broadcast((found.column("qid").combine_chunks(), q))

    def unit(x):
        n = np.sqrt((x * x).sum(1, keepdims=True))
        return np.divide(x, n, out=np.zeros_like(x), where=n > 0)

    def search(batches):
        names, q = held.value
        ids, uq = names.to_numpy(), unit(q)
        for b in batches:
            own = b.column(0).to_numpy()
            x = b.column(1).flatten().to_numpy().reshape(b.num_rows, -1)
            ux, step = unit(x), max(1, HELD // max(1, len(x)))
            for at in range(0, len(q) if len(x) else 0, step):
                near = uq[at : at + step] @ ux.T
                near[ids[at : at + step, None] == own[None, :]] = -2
                last = max(0, len(x) - k)
                i, j = np.nonzero((near >= np.partition(near, last, axis=1)[:, last : last + 1] - 1e-8) & (near > -1.5))
                i += at
                dot, nx, nq = np.zeros(len(i)), np.zeros(len(i)), np.zeros(len(i))
                for d in range(x.shape[1]):
                    a, c = x[j, d], q[i, d]
                    dot, nx, nq = dot + a * c, nx + a * a, nq + c * c
                n = np.sqrt(nx) * np.sqrt(nq)
                yield pa.RecordBatch.from_arrays([pa.array(ids[i]), pa.array(own[j]), pa.array(np.divide(dot, n, out=np.zeros_like(dot), where=n > 0))], ["qid", "item_id", "score"])

    return vectors.select("item_id", "v").mapInArrow(search, f"qid {dict(asked.dtypes)['qid']}, item_id {dict(vectors.dtypes)['item_id']}, score double")
