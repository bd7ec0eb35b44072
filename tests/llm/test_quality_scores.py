"""The compression classifier against its definition in plain Python, and its scores against frequencies."""

import math
import random

import numpy as np
import zstandard as zstd
from pyspark.sql import functions as F

from docweave.llm import quality, queries
from docweave.llm.common import fold_of

SF = "/root/testdata/sf0.01"
GOOD, BAD = "river stone walks quiet house under bright morning letter garden".split(), "click buy now free win cash offer deal bonus vip".split()


def mixed(rng, share):
    return " ".join(rng.choice(GOOD if rng.random() < share else BAD) for _ in range(40))


def plain_score(model, data):
    """As the docstring of the module has it."""
    if not data:
        return model.share
    sizes = []
    for dictionary in model.dictionaries:
        d = zstd.ZstdCompressionDict(dictionary)
        sizes.append(sum(len(zstd.ZstdCompressor(level=3, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False).compress(data[i : i + 512])) for i in range(0, len(data), 512)))
    bad, good = sizes
    a, b, c, e = model.weights
    z = a + b * (bad - good) / max(sizes) + c * (bad - good) / len(data) + e * good / len(data)
    return 1 / (1 + math.exp(-max(-30, min(30, z))))


def test_scores_follow_their_definition(spark):
    rng = random.Random(1)
    rows = [(mixed(rng, 0.9 if y else 0.1).encode(), y) for y in [0, 1] * 60]
    model = quality.Model(rows)
    texts = [mixed(rng, rng.random()) for _ in range(30)] + ["", "é" * 700, "x " * 40_000]
    assert all(abs(model.score(t.encode()) - plain_score(model, t.encode())) < 1e-12 for t in texts)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(99, None)], "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.score for r in quality.score_quality(docs, model).collect()}
    assert all(abs(got[i] - plain_score(model, t.encode())) < 1e-12 for i, t in enumerate(texts)) and got[99] == model.share
    # the curve is where the penalised likelihood is level, over the half of the rows that trained no dictionary
    rest = [(t, y) for y in (0, 1) for t in [t for t, label in rows if label == y][1::2]]
    x = np.array([[1, *quality.features(t, model.machines())] for t, _ in rest])
    p = 1 / (1 + np.exp(-x @ model.weights))
    assert np.abs(x.T @ (np.array([y for _, y in rest]) - p) - 1e-2 * model.weights).max() < 1e-6


def test_scores_are_calibrated_where_labels_are_uncertain():
    """Texts whose label is a matter of chance: in each tenth of the scores, as many have label 1 as the scores say."""
    rng = random.Random(7)

    def drawn(n):
        out = []
        for _ in range(n):
            share = rng.random()
            out.append((mixed(rng, share).encode(), int(rng.random() < 1 / (1 + math.exp(-8 * (share - 0.5))))))
        return out

    model = quality.Model(drawn(1500))
    held = drawn(1500)
    scores, labels = np.array([model.score(t) for t, _ in held]), np.array([y for _, y in held])
    brier, base = ((scores - labels) ** 2).mean(), labels.mean() * (1 - labels.mean())
    assert brier < 0.7 * base
    bins = np.digitize(scores, np.linspace(0, 1, 6)[1:-1])
    for b in range(5):
        if (n := (bins == b).sum()) >= 50:
            assert abs(scores[bins == b].mean() - labels[bins == b].mean()) < 3.5 * math.sqrt(0.25 / n) + 0.03


def test_query_over_the_tables(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = queries.op7_quality(spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(r.held_out == (fold_of(r.doc_id, 5) == 0) and r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1 for r in rows)
    held = [(r.score, labels[r.doc_id]) for r in rows if r.held_out and labels.get(r.doc_id) in (0, 1)]
    assert len(held) > 30 and np.mean([(s - y) ** 2 for s, y in held]) < 0.05
    assert queries.op7_quality(spark, SF).where(F.col("score").isNull()).isEmpty()
