"""Blocked Bloom filters over 64-bit hashes, built in Spark; their size is bounded whatever the number of keys."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words of 32 bits in a block; a key sets one bit in each, so a probe touches 32 adjacent bytes.
WORDS = 8
#: Odd multipliers, one for each word, without a pattern that would tie the words' bits together.
SALTS = np.array([int.from_bytes(hashlib.sha256(bytes([i])).digest()[:4], "little") | 1 for i in range(WORDS)], dtype=np.uint64)
BITS_PER_KEY = 16
_LOW = np.uint64(0xFFFFFFFF)


def spread(h: np.ndarray) -> np.ndarray:
    """Keys need not be even over their range (minima of hashes are not): their bits are mixed first."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9FB21C651E98DF25)
    return h ^ (h >> np.uint64(28))


def masks(h: np.ndarray) -> np.ndarray:
    """One bit in each of the block's words, of the hash's low half."""
    return (np.uint64(1) << ((((h & _LOW)[:, None] * SALTS) & _LOW) >> np.uint64(27))).astype(np.uint32)


def blocks(h: np.ndarray, n: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def contains(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    m = masks(h := spread(h))
    return ((bits[blocks(h, len(bits))] & m) == m).all(axis=1)


def build(hashes: DataFrame, n_keys: int, max_bytes: int) -> np.ndarray:
    """Blocks x words of the keys in the only column, OR-ed together in Spark before the driver gets them."""
    n = max(1, min(max_bytes // (4 * WORDS), -(-n_keys * BITS_PER_KEY // (32 * WORDS))))

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h = spread(b.column(0).to_numpy().view(np.uint64))
            m = masks(h)
            # two words to a long, in the order of the block's bytes
            yield pa.RecordBatch.from_arrays([pa.array(blocks(h, n)), *(pa.array(x) for x in m.view(np.int64).T)], ["block", *(f"w{i}" for i in range(WORDS // 2))])

    parts = hashes.mapInArrow(words, "block long, " + ", ".join(f"w{i} long" for i in range(WORDS // 2)))
    out = np.zeros((n, WORDS // 2), dtype=np.int64)
    for b in parts.groupBy("block").agg(*(F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS // 2))).toArrow().to_batches():
        for i in range(WORDS // 2):
            out[b.column(0).to_numpy(), i] = b.column(i + 1).to_numpy()
    return out.view(np.uint32)
