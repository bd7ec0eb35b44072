"""Cuckoo filters: sets of keys in two bytes each that forget a key again.

A key is a pair of even 64-bit numbers.  Its fingerprint lies in one of two buckets of four places; either bucket and the fingerprint
give the other one.  A fingerprint that no bucket has room for, after ``KICKS`` moves, is kept aside, so inserting never
fails; a filter that holds over ``FULL`` of its places is built anew, larger, by who owns the keys.
"""

from __future__ import annotations

import struct

import numpy as np

PLACES = 4
KICKS = 200
FULL = 0.85
#: 48 bits: products with fingerprints stay under 2**64.
_MIX = np.uint64(0x9E3779B97F4B)
_HEAD = struct.Struct("<QQQ")


def fingerprints(low: np.ndarray) -> np.ndarray:
    """1 to 65535; 0 marks an empty place."""
    return (low % np.uint64(65535) + np.uint64(1)).astype(np.uint16)


class Filter:
    def __init__(self, keys: int = 0):
        buckets = 1
        while buckets * PLACES * FULL < keys:
            buckets *= 2
        self.table = np.zeros((buckets, PLACES), dtype=np.uint16)
        self.aside: list[tuple[int, int]] = []  # (smaller of the two buckets, fingerprint)
        self.size = 0

    def __len__(self) -> int:
        return self.size

    @property
    def full(self) -> bool:
        return self.size > FULL * self.table.size

    def first(self, high: np.ndarray) -> np.ndarray:
        return (high & np.uint64(len(self.table) - 1)).astype(np.int64)

    def other(self, bucket: np.ndarray, fp: np.ndarray) -> np.ndarray:
        turn = ((fp.astype(np.uint64) * _MIX) >> np.uint64(20)) & np.uint64(len(self.table) - 1)
        return bucket ^ turn.astype(np.int64)

    def insert(self, high: np.ndarray, low: np.ndarray) -> None:
        """Keys that are not in the set."""
        fp, bucket = fingerprints(low), self.first(high)
        self.size += len(fp)
        for attempt in range(2):  # most find room at once in one of their buckets
            order = np.argsort(bucket, kind="stable")
            fp, bucket = fp[order], bucket[order]
            nth = np.arange(len(bucket)) - np.searchsorted(bucket, bucket)
            empty = self.table[bucket] == 0
            fits = nth < empty.sum(axis=1)
            place = (np.cumsum(empty, axis=1) == (nth + 1)[:, None]).argmax(axis=1)
            self.table[bucket[fits], place[fits]] = fp[fits]
            fp, bucket = fp[~fits], self.other(bucket[~fits], fp[~fits])
        for f, b in zip(fp, bucket):
            self._push(f, int(b))

    def _push(self, fp: np.uint16, bucket: int) -> None:
        for kick in range(KICKS):
            empty = np.flatnonzero(self.table[bucket] == 0)
            if len(empty):
                self.table[bucket, empty[0]] = fp
                return
            place = (int(fp) + kick) % PLACES
            fp, self.table[bucket, place] = self.table[bucket, place], fp
            bucket = int(self.other(np.int64(bucket), fp))
        self.aside.append((min(bucket, int(self.other(np.int64(bucket), fp))), int(fp)))

    def delete(self, high: np.ndarray, low: np.ndarray) -> None:
        """Keys that are in the set: one copy of each one's fingerprint goes."""
        for f, b in zip(fingerprints(low), self.first(high)):
            c = self.other(b, f)
            for bucket in (b, c):
                at = np.flatnonzero(self.table[bucket] == f)
                if len(at):
                    self.table[bucket, at[0]] = 0
                    break
            else:
                self.aside.remove((int(min(b, c)), int(f)))
            self.size -= 1

    def contains(self, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        """True for every key of the set, and for about one in 8,000 others."""
        fp, bucket = fingerprints(low), self.first(high)
        found = (self.table[bucket] == fp[:, None]).any(axis=1)
        other = self.other(bucket, fp)
        found |= (self.table[other] == fp[:, None]).any(axis=1)
        if self.aside:
            kept = set(self.aside)
            found |= np.fromiter(((int(min(b, c)), int(f)) in kept for b, c, f in zip(bucket, other, fp)), bool, len(fp))
        return found

    def to_bytes(self) -> bytes:
        extra = np.array(self.aside, dtype="<i8").reshape(-1, 2)
        return _HEAD.pack(len(self.table), len(extra), self.size) + self.table.astype("<u2").tobytes() + extra.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> Filter:
        out = cls()
        buckets, extra, out.size = _HEAD.unpack_from(data)
        out.table = np.frombuffer(data, "<u2", buckets * PLACES, _HEAD.size).reshape(buckets, PLACES).copy()
        out.aside = [(int(b), int(f)) for b, f in np.frombuffer(data, "<i8", 2 * extra, _HEAD.size + out.table.nbytes).reshape(extra, 2)]
        return out
