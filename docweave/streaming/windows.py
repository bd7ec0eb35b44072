"""Structured Streaming over event files: event-time windows, a stateful limiter, timed buffers, and a sink of what is there."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def folder(spark: SparkSession, tag: str) -> str:
    """A new folder under ``spark.checkpoint.dir``; of this machine only where that is unset on a local master."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="docweave-")
    return f"{base.rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def event_stream(spark: SparkSession, path: str) -> DataFrame:
    """Events of a file or folder as a stream, at most 100 files a batch; late by up to ten minutes."""
    schema = spark.read.parquet(path).schema
    path = f"{path[:-1]}[{path[-1]}]"  # a stream takes a single file only by a pattern
    events = spark.readStream.schema(schema).option("maxFilesPerTrigger", 100).parquet(path)
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "10 minutes")


def windowed_counts(events: DataFrame, width: str, slide: str | None = None) -> DataFrame:
    """Counts and sums; in update mode a window's state goes once the watermark is past it."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    return events.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value")).select(F.col("w.start").alias("start"), "event_type", "n", "value")


def seconds_of(ts: pd.Series) -> pd.Series:
    return ts.astype("datetime64[us]").astype("int64") / 1e6


def expire_at(state: GroupState, seconds: float) -> None:
    """Let the state time out once the watermark passes this moment."""
    state.setTimeoutTimestamp(max(int(seconds * 1000) + 1, state.getCurrentWatermarkMs() + 1))


def limiter(events: DataFrame, seconds: int, limit: int) -> DataFrame:
    """(user_id, event_id, allowed): a sliding window for each user; the state is the times of hits let through, at most ``limit``.

    Hits are folded in event time within a batch, as a stateful operator sees them.  State goes once the watermark is past all that it could
    refuse; events older than the watermark are dropped.
    """

    def fold(key: tuple[Any, ...], parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        kept = list(state.get[0]) if state.exists else []
        pdf = pd.concat(list(parts)).sort_values(["ts", "event_id"])
        allowed = []
        for now in seconds_of(pdf["ts"]):
            kept = [t for t in kept if t > now - seconds]
            allowed.append(len(kept) < limit)
            if allowed[-1]:
                kept.append(now)
        state.update((kept,))
        expire_at(state, max(kept, default=0.0) + seconds)
        yield pd.DataFrame({"user_id": key[0], "event_id": pdf["event_id"].to_numpy(), "allowed": allowed})

    return events.select("user_id", "event_id", "ts").groupBy("user_id").applyInPandasWithState(fold, "user_id long, event_id long, allowed boolean", "kept array<double>", "append", GroupStateTimeout.EventTimeTimeout)


def buffers(events: DataFrame, size: int, seconds: float, ends: list[str]) -> DataFrame:
    """(user_id, first, last, n, why): each user's events gathered until ``size`` of them ("size"), one of the types ``ends`` ("end"), or
    ``seconds`` after the first ("time").

    The state is first and last time and a count.  Where no later event of the user does it, a timer flushes what is held once the watermark
    is past its time, and the state goes.  Events older than the watermark, or without a time or user, are dropped.  What is held when the stream stops stays in its
    checkpoint, and the next run goes on from there.
    """

    def fold(key: tuple[Any, ...], parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(state.get) if state.exists else None
        out: list[tuple] = []
        if state.hasTimedOut:
            out.append((*held, "time"))
            held = None
        else:
            pdf = pd.concat(list(parts)).sort_values(["ts", "event_id"])
            for now, kind in zip(seconds_of(pdf["ts"]), pdf["event_type"]):
                if held and now - held[0] >= seconds:
                    out.append((*held, "time"))
                    held = None
                held = [held[0], max(held[1], now), held[2] + 1] if held else [now, now, 1]
                if held[2] >= size or kind in ends:
                    out.append((*held, "end" if kind in ends else "size"))
                    held = None
        if held:
            state.update(tuple(held))
            expire_at(state, held[0] + seconds)
        elif state.exists:
            state.remove()
        if out:
            yield pd.DataFrame([(key[0], *row) for row in out], columns=["user_id", "first", "last", "n", "why"])

    found = events.where("ts IS NOT NULL AND user_id IS NOT NULL").select("user_id", "event_id", "ts", "event_type").groupBy("user_id").applyInPandasWithState(fold, "user_id long, first double, last double, n long, why string", "first double, last double, n long", "append", GroupStateTimeout.EventTimeTimeout)
    at = lambda c: F.timestamp_micros(F.round(F.col(c) * 1e6).cast("long")).alias(c)
    return found.select("user_id", at("first"), at("last"), "n", "why")


def run(result: DataFrame, mode: str, tag: str, keys: list[str] | None = None, checkpoint: str | None = None) -> DataFrame:
    """All that is there now, to the end.  Appended rows gather in one folder; of updates, the last for each of ``keys`` holds.

    checkpoint: a folder of an earlier run to go on from; its results are not in the answer.
    """
    spark = result.sparkSession
    out = folder(spark, tag)
    numbered = result.select("*", F.lit(0).cast("long").alias("_batch"))
    # the first write keeps the schema even if no batch has rows
    spark.createDataFrame([], numbered.schema).write.parquet(out)
    # a batch that is repeated after a fault replaces itself
    sink = lambda df, n: df.withColumn("_batch", F.lit(n).cast("long")).write.mode("overwrite").parquet(f"{out}/batch={n}")
    q = result.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", checkpoint or folder(spark, f"{tag}-state")).foreachBatch(sink).start()
    q.awaitTermination()
    rows = spark.read.schema(numbered.schema).option("recursiveFileLookup", "true").parquet(out)
    if mode != "update":
        return rows.drop("_batch")
    rest = [c for c in result.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_batch").alias("_last")).select(*keys, "_last.*").select(*result.columns)
