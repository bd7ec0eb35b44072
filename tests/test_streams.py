"""Streams with state that expires: late data, restarts, timers."""

from collections import defaultdict
from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from docweave.plans import registry
from docweave.streaming import windows as W

SF = "/root/testdata/sf0.001"
START = datetime(2024, 1, 1, tzinfo=timezone.utc)


def written(spark, at, name, rows):
    """rows: (minute, user, type)."""
    df = spark.createDataFrame([(i, START + timedelta(minutes=m), u, k, 1.0) for i, (m, u, k) in enumerate(rows)], "event_id long, ts timestamp, user_id long, event_type string, value double")
    df.coalesce(1).write.mode("append").parquet(str(at))
    return name


def stream(spark, at):
    return spark.readStream.schema(spark.read.parquet(str(at)).schema).option("maxFilesPerTrigger", 1).parquet(str(at)).withWatermark("ts", "10 minutes")


def plain(rows, size, minutes, ends, watermark):
    """Flushes of (minute, user, type) in order, and those whose time the watermark has passed."""
    held, out = {}, []
    for m, u, k in sorted(rows):
        if u in held and m - held[u][0] >= minutes:
            out.append((u, *held.pop(u), "time"))
        held[u] = (held[u][0], m, held[u][2] + 1) if u in held else (m, m, 1)
        if held[u][2] >= size or k in ends:
            out.append((u, *held.pop(u), "end" if k in ends else "size"))
    out += [(u, *h, "time") for u, h in held.items() if h[0] + minutes < watermark]
    return sorted(out)


def minutes_of(rows):
    at = lambda t: (t - START.replace(tzinfo=None)).total_seconds() / 60
    return sorted((r.user_id, at(r["first"]), at(r["last"]), r.n, r.why) for r in rows)


def test_buffers_flush_by_size_end_and_time_across_restarts(spark, tmp_path):
    first = [(0, 1, "view"), (1, 1, "view"), (2, 1, "click"), (3, 2, "purchase"), (4, 3, "view"), (5, 1, "view"), (40, 2, "view")]
    later = [(41, 1, "view"), (42, 1, "view"), (5, 3, "view"), (100, 4, "view")]  # the third is older than the watermark of 30
    state = f"{tmp_path}/state"
    written(spark, tmp_path / "in", "a", first)
    one = minutes_of(W.run(W.buffers(stream(spark, tmp_path / "in"), 3, 25 * 60, ["purchase"]), "append", "one", checkpoint=state).collect())
    assert one == plain(first, 3, 25, ["purchase"], 30)  # user 3 by its timer; one event of user 1 is held until minute 30
    written(spark, tmp_path / "in", "b", later)
    two = minutes_of(W.run(W.buffers(stream(spark, tmp_path / "in"), 3, 25 * 60, ["purchase"]), "append", "two", checkpoint=state).collect())
    whole = plain(first + [r for r in later if r != (5, 3, "view")], 3, 25, ["purchase"], 90)
    assert sorted(one + two) == whole
    held = spark.read.format("statestore").load(state).select("value.*").collect()
    assert len(held) == 1  # user 4 alone: what was flushed left no state


def test_windows_forget_and_late_data_is_dropped(spark, tmp_path):
    written(spark, tmp_path / "in", "a", [(0, 1, "view"), (5, 1, "view"), (200, 1, "view")])
    state = f"{tmp_path}/state"
    first = W.run(W.windowed_counts(stream(spark, tmp_path / "in"), "1 hour"), "update", "one", ["start", "event_type"], state)
    assert sorted(r.n for r in first.collect()) == [1, 2]
    assert spark.read.format("statestore").load(state).count() == 1  # the first hour's window is gone
    written(spark, tmp_path / "in", "b", [(10, 1, "view"), (201, 1, "view")])
    again = W.run(W.windowed_counts(stream(spark, tmp_path / "in"), "1 hour"), "update", "two", ["start", "event_type"], state)
    assert [r.n for r in again.collect()] == [2]


def test_limiter_state_expires(spark, tmp_path):
    written(spark, tmp_path / "in", "a", [(0, 1, "view"), (1, 1, "view"), (2, 1, "view"), (3, 2, "view"), (300, 3, "view")])
    state = f"{tmp_path}/state"
    got = {r.event_id: r.allowed for r in W.run(W.limiter(stream(spark, tmp_path / "in"), 600, 2), "append", "one", checkpoint=state).collect()}
    assert got == {0: True, 1: True, 2: False, 3: True, 4: True}
    assert spark.read.format("statestore").load(state).select("key.user_id").collect()[0].user_id == 3
    assert spark.read.format("statestore").load(state).count() == 1


def test_buffers_of_the_tables(spark):
    events = spark.read.parquet(f"{SF}/events.parquet").select("user_id", "event_type", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t")).orderBy("t", "event_id").collect()
    by_user = defaultdict(list)
    for r in events:
        by_user[r.user_id].append((r.t / 1e6, r.event_type))
    rows = [(t, u, k) for u, es in by_user.items() for t, k in es]
    want = plain(rows, 5, 6 * 3600, ["purchase"], max(t for t, _, _ in rows) - 600)
    got = sorted((r.user_id, r.a / 1e6, r.b / 1e6, r.n, r.why) for r in registry.QUERIES["stream_buffers"](spark, SF).select("user_id", F.unix_micros("first").alias("a"), F.unix_micros("last").alias("b"), "n", "why").collect())
    assert [(u, n, w) for u, _, _, n, w in got] == [(u, n, w) for u, _, _, n, w in want]
    assert all(abs(g[1] - w[1]) < 1e-3 and abs(g[2] - w[2]) < 1e-3 for g, w in zip(got, want))
