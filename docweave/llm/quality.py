"""Compression classifier for text quality.

Two zstandard dictionaries are trained, one on good and one on bad labelled text.  A text is compressed with each, in cuts
of ``CUT`` bytes so that a long text's own repeats do not replace the dictionary.  The difference of the compressed sizes,
normalised by the larger size and by the text's length, and the compressed share of the length go through a logistic curve
fitted on the training rows, which makes the score a calibrated probability of label 1.

Training uses a bounded sample: ``TRAIN_BYTES`` of text for each label for the dictionaries, ``TRAIN_ROWS`` rows for the curve.

Edge cases: null and empty texts have size difference zero and get the score of the label's share alone.  If a label is missing
from the training rows, every score is the share of label 1 (0.5 without any labelled row).  Repeated rows score alike;
several labels of one id each count as a training row; a null id is never labelled.  ``score`` takes the place of a kept column
of that name.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import zstandard as zstd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from docweave.llm.common import aside, per_step, share_of

CUT = 512
LEVEL = 3
DICTIONARY_BYTES = 112 << 10
TRAIN_BYTES = 4 << 20
TRAIN_ROWS = 6000
_machines: dict[str, list[zstd.ZstdCompressor]] = {}


def cuts(data: bytes) -> list[bytes]:
    return [data[i : i + CUT] for i in range(0, len(data), CUT)]


def train_dictionary(texts: list[bytes]) -> bytes:
    """A trained dictionary; where there is too little text to train one, the text itself serves."""
    pieces = [p for t in texts for p in cuts(t)]
    try:
        return zstd.train_dictionary(min(DICTIONARY_BYTES, max(256, sum(map(len, pieces)) // 8)), pieces).as_bytes()
    except (zstd.ZstdError, ValueError):
        return b"".join(pieces)[-DICTIONARY_BYTES:] or b"\0" * 16


def compressor(dictionary: bytes) -> zstd.ZstdCompressor:
    d = zstd.ZstdCompressionDict(dictionary)
    d.precompute_compress(level=LEVEL)
    return zstd.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)


def features(data: bytes, machines: list[zstd.ZstdCompressor]) -> tuple[float, float, float]:
    if not data:
        return 0.0, 0.0, 0.0
    bad, good = (sum(len(m.compress(p)) for p in cuts(data)) for m in machines)
    return (bad - good) / max(bad, good), (bad - good) / len(data), good / len(data)


def fit_curve(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 50) -> np.ndarray:
    """Logistic regression by Newton's method: intercept first."""
    x = np.column_stack((np.ones(len(x)), x))
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


class Model:
    """Dictionaries of bad and good text, the curve's weights, and the share of label 1 for texts that say nothing."""

    def __init__(self, rows: list[tuple[bytes, int]]):
        self.token = uuid.uuid4().hex
        self.share = sum(y for _, y in rows) / len(rows) if rows else 0.5
        self.dictionaries: list[bytes] = []
        by = {label: [t for t, y in rows if y == label and t] for label in (0, 1)}
        if not by[0] or not by[1]:
            return
        # one half trains the dictionaries, the other the curve, so that the curve sees texts the dictionaries do not hold
        self.dictionaries = [train_dictionary(by[label][::2] or by[label]) for label in (0, 1)]
        rest = [(t, label) for label in (0, 1) for t in (by[label][1::2] or by[label])]
        x = np.array([features(t, self.machines()) for t, _ in rest])
        self.weights = fit_curve(x, np.array([y for _, y in rest], dtype=float))

    def machines(self) -> list[zstd.ZstdCompressor]:
        if self.token not in _machines:
            _machines.clear()
            _machines[self.token] = [compressor(d) for d in self.dictionaries]
        return _machines[self.token]

    def score(self, data: bytes) -> float:
        if not self.dictionaries or not data:
            return self.share
        z = self.weights[0] + np.dot(self.weights[1:], features(data, self.machines()))
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def training_rows(docs: DataFrame, labels: DataFrame, where: Column, label: str, id_column: str = "doc_id", text_column: str = "text", most_bytes: int = TRAIN_BYTES, most_rows: int = TRAIN_ROWS) -> list[tuple[bytes, int]]:
    """Labelled (text, label) rows under ``where``, by id hash, at most ``most_rows`` and ``2 * most_bytes`` for each label."""
    rank = share_of(F.col(id_column), F.lit("train"))
    marked = labels.where(where & F.col(label).isin(0, 1) & F.col(id_column).isNotNull()).select(id_column, F.col(label).cast("int").alias("y"), rank.alias("rank"))
    counts = {r.y: r.n for r in marked.groupBy("y").agg(F.count("*").alias("n")).collect()}
    out: list[tuple[bytes, int]] = []
    for y, n in sorted(counts.items()):
        share = min(1.0, most_rows / n)
        some = marked.where((F.col("y") == y) & (F.col("rank") < share))
        held = 0
        # the ids are few and bounded: they are sent to the documents, not the documents to them
        for row in docs.select(id_column, text_column).join(F.broadcast(some), id_column).select("rank", F.col(text_column).alias("text")).orderBy("rank", "text").toLocalIterator():
            if held > 2 * most_bytes:
                break
            out.append(((row.text or "").encode(), y))
            held += len(out[-1][0])
    return out


def score_quality(docs: DataFrame, model: Model, text_column: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The ``keep`` columns (all by default) and ``score``, the probability of label 1."""
    carried, names = aside(docs, keep or docs.columns, ["score"])
    shared = docs.sparkSession.sparkContext.broadcast(model)
    source = docs.select(*carried, F.col(text_column).alias("_judged"))

    def judge(b: pa.RecordBatch) -> pa.RecordBatch:
        scores = [shared.value.score(t or b"") for t in b.column(b.num_columns - 1).cast(pa.binary()).to_pylist()]
        return pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(scores, pa.float64())], [*b.schema.names[:-1], "score"])

    schema = StructType(source.schema.fields[:-1]).add("score", DoubleType())
    return source.mapInArrow(per_step(judge, "_judged"), schema).toDF(*names, "score")
