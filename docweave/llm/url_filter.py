"""URL filter: a blocked Bloom filter of listed canonical URLs lets possible hits pass to an exact hash join.

A listed entry is a host and a path prefix; it fits its host, every subdomain, and every path that starts with its path.
Entries are of two kinds: *rules* (allow or block; the longest that fits wins), which are held against host and path as they
stand in the url, and *listed* URLs (block where no rule fits), which are canonical and held against canonical urls: user
information, port and final dots of the host go, international names become ASCII, escapes of unreserved characters are
decoded, those that stay are upper case, and dot segments are resolved.

A listed url whose host begins with "www." stands for the whole site, as the same url without it does.

Edge cases: of two rules of one host and path that differ in their verdict, block holds.  A null url, or one without ``://``, has empty host and path, fits nothing and is allowed.  Repeated entries count
once.  Repeated page rows each get their own verdict.  Extra columns of the pages are not read.  With an empty list every
page is allowed.  A host that is no valid international name stays as it is.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.llm import bloom

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The filter never exceeds this, whatever the list's length: beyond it more false hits pass on to the exact join.
MAX_FILTER_BYTES = 8 << 20
ESCAPE = re.compile(r"%([0-9A-Fa-f]{2})")
PORT = re.compile(r":\d*$")


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def canonical(host: str, path: str) -> tuple[str, str]:
    """Spellings of one address give one key."""
    host = ESCAPE.sub(_unescaped, host).rpartition("@")[2].lower()
    host = PORT.sub("", host).rstrip(".")
    if not host.isascii():
        try:
            host = ".".join(label.encode("idna").decode() if label else "" for label in host.split("."))
        except UnicodeError:
            pass
    path = ESCAPE.sub(_unescaped, path) or "/"
    if "/." in path:
        out: list[str] = []
        steps = path.split("/")
        for i, step in enumerate(steps):
            if step in (".", ".."):
                if step == ".." and len(out) > 1:
                    out.pop()
                if i == len(steps) - 1:
                    out.append("")
            else:
                out.append(step)
        path = "/".join(out) if len(out) > 1 else "/"
    return host, path


def _unescaped(m: re.Match) -> str:
    c = chr(int(m[1], 16))
    return c if c.isascii() and (c.isalnum() or c in "-._~") else m[0].upper()


def entries(spark: SparkSession, rules: list[tuple[str, str]], listed: DataFrame | None = None) -> DataFrame:
    """(kind, host, path, rule, verdict), each key once.  rules: ("allow"|"block", "host/path"); listed: a column ``url``."""
    rows = [("R", r.partition("/")[0].lower(), "/" + r.partition("/")[2] if r.partition("/")[2] else "/", r, v) for v, r in rules]
    out = spark.createDataFrame(rows, "kind string, host string, path string, rule string, verdict string")
    if listed is not None:

        def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                found = [canonical(h, p) for h, p in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
                yield pa.RecordBatch.from_arrays([pa.array([h.removeprefix("www.") for h, _ in found], pa.string()), pa.array([p for _, p in found], pa.string())], ["host", "path"])

        url = F.col("url")
        clean_urls = listed.select(host_of(url).alias("host"), path_of(url).alias("path")).mapInArrow(clean, "host string, path string").where("host != ''")
        out = out.unionByName(clean_urls.select(F.lit("L").alias("kind"), "host", "path", F.lit(None).cast("string").alias("rule"), F.lit("block").alias("verdict")))
    # block is greater than allow; of one verdict's spellings the last
    best = out.groupBy("kind", "host", "path").agg(F.max(F.struct("verdict", "rule")).alias("best"))
    return best.select("kind", "host", "path", "best.rule", "best.verdict")


def hashes(keys: list[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(k) for k in keys), np.uint64, len(keys))


def keys_of(kind: str, host: str, path: str) -> tuple[str, str]:
    return f"{kind}|{host}", f"{kind}|{host}|{path}"


def build_filter(listed: DataFrame) -> np.ndarray:
    """The filter of all entries: a key for each host, and one for each host and path."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h = hashes([k for row in zip(*(b.column(i).to_pylist() for i in range(3))) for k in keys_of(*row)])
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64))], ["h"])

    return bloom.build(listed.select("kind", "host", "path").mapInArrow(hashed, "h long"), 2 * listed.count(), MAX_FILTER_BYTES)


def possible_hits(urls: DataFrame, listed: DataFrame) -> DataFrame:
    """(host, path, kind, entry_host, entry_path) of each pair that the filter lets pass."""
    shape = {r.kind: r for r in listed.groupBy("kind").agg(F.max(F.size(F.split("host", r"\."))).alias("labels"), F.array_sort(F.collect_set(F.length("path"))).alias("lengths")).collect()}
    labels, lengths = {k: r.labels for k, r in shape.items()}, {k: list(r.lengths) for k, r in shape.items()}
    shared = urls.sparkSession.sparkContext.broadcast(build_filter(listed))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value

        def passes(keys: list[str]) -> np.ndarray:
            return bloom.contains(bits, hashes(keys))

        for b in batches:
            hosts, paths = b.column(0).to_pylist(), b.column(1).to_pylist()
            as_read = {"R": [(h, p or "/") for h, p in zip(hosts, paths)], "L": [canonical(h, p) for h, p in zip(hosts, paths)]}
            ends = [(i, kind, ".".join(part[k:])) for kind in labels for i, (host, _) in enumerate(as_read[kind]) for part in [host.split(".")] for k in range(max(0, len(part) - labels[kind]), len(part))]
            ends = [e for e, ok in zip(ends, passes([f"{kind}|{s}" for _, kind, s in ends])) if ok] if ends else []
            full = [(i, kind, s, path[:n]) for i, kind, s in ends for path in [as_read[kind][i][1]] for n in lengths[kind] if n <= len(path)]
            full = [x for x, ok in zip(full, passes([f"{kind}|{s}|{p}" for _, kind, s, p in full])) if ok] if full else []
            columns = [[hosts[x[0]] for x in full], [paths[x[0]] for x in full], *([x[k] for x in full] for k in (1, 2, 3))]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], ["host", "path", "kind", "entry_host", "entry_path"])

    return urls.mapInArrow(probe, "host string, path string, kind string, entry_host string, entry_path string")


def filter_urls(pages: DataFrame, listed: DataFrame, id_column: str = "page_id") -> DataFrame:
    """Each page's id, host, path, winning rule (or null), verdict, and whether a listed URL fits it."""
    parsed = pages.select(F.col(id_column), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    urls = parsed.where(F.col("host") != "").select("host", "path").distinct()  # a hot url is judged once
    exact = listed.select("kind", F.col("host").alias("entry_host"), F.col("path").alias("entry_path"), "rule", F.col("verdict").alias("entry_verdict"))
    hits = possible_hits(urls, listed).join(exact, ["kind", "entry_host", "entry_path"])
    rule = F.when((F.col("kind") == "R") & F.startswith(F.col("path"), F.col("entry_path")), F.struct(F.length("rule").alias("n"), F.col("rule"), F.col("entry_verdict").alias("verdict")))
    judged = hits.groupBy("host", "path").agg(F.max(rule).alias("best"), F.coalesce(F.bool_or(F.col("kind") == "L"), F.lit(False)).alias("listed"))
    verdict = F.coalesce(F.col("best.verdict"), F.when(F.col("listed"), "block"), F.lit("allow"))
    return parsed.join(judged, ["host", "path"], "left").select(id_column, "host", "path", F.col("best.rule").alias("rule"), verdict.alias("verdict"), F.coalesce("listed", F.lit(False)).alias("listed"))
