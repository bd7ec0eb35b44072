"""Events as a stream, run to the end of what is there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.plans.base import query
from docweave.streaming import windows as W


def _counts(spark: SparkSession, d: str, width: str, slide: str | None, tag: str) -> DataFrame:
    out = W.run(W.windowed_counts(W.event_stream(spark, f"{d}/events.parquet"), width, slide), "update", tag, ["start", "event_type"])
    return out.select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n", F.round("value", 4).alias("value"))


@query("SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY 1, 2")
def stream_tumbling_counts(spark: SparkSession, d: str) -> DataFrame:
    return _counts(spark, d, "1 hour", None, "tumbling")


@query("SELECT strftime(date_trunc('hour', ts) - to_hours(CAST(k AS INTEGER)), '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events, range(0, 3) r(k) GROUP BY 1, 2")
def stream_sliding_counts(spark: SparkSession, d: str) -> DataFrame:
    return _counts(spark, d, "3 hours", "1 hour", "sliding")


@query()
def stream_rate_limiter(spark: SparkSession, d: str) -> DataFrame:
    """The limiter of behaviour analytics as a stateful stream; a test holds it to the batch fold."""
    return W.run(W.limiter(W.event_stream(spark, f"{d}/events.parquet"), 3600, 3), "append", "limiter")


@query()
def stream_buffers(spark: SparkSession, d: str) -> DataFrame:
    """(user_id, first, last, n, why): users' events flushed at five, at a purchase, or six hours after the first; a test folds them plainly."""
    return W.run(W.buffers(W.event_stream(spark, f"{d}/events.parquet"), 5, 6 * 3600, ["purchase"]), "append", "buffers")
