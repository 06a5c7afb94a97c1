"""Windows over event time, the same for a table and a stream, and a rate limiter with state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def _late(events: DataFrame, delay: str) -> DataFrame:
    return events.withWatermark("ts", delay) if events.isStreaming else events


def tumbling(events: DataFrame, width: str, delay: str = "1 day") -> DataFrame:
    """(event_type, window_start, n, total) by windows of fixed width; on a stream, events later than `delay` are left out."""
    out = _late(events, delay).groupBy("event_type", F.window("ts", width).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 6).alias("total"))
    return out.select("event_type", F.col("w.start").alias("window_start"), "n", "total")


def sessions(events: DataFrame, gap: str, delay: str = "1 day") -> DataFrame:
    """(user_id, session_start, session_end, n): stretches of events less than `gap` apart; rows without user are left out."""
    out = _late(events.where("user_id IS NOT NULL"), delay).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return out.select("user_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def anchored_windows(events: DataFrame, seconds: int, most: int) -> DataFrame:
    """(user_id, window_start, n, refused): windows that begin with the first event after the last one, of a table.

    Rows stream by in the order of user and time and only one window is held, so a user may have any number of events.
    """
    ordered = events.where("user_id IS NOT NULL AND ts IS NOT NULL").select("user_id", "ts").repartition("user_id").sortWithinPartitions("user_id", "ts")

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        user, start, n = None, None, 0
        rows = []
        for batch in batches:
            for u, t in batch.itertuples(index=False):
                if u != user or (t - start).total_seconds() >= seconds:
                    if user is not None:
                        rows.append((user, start, n, max(0, n - most)))
                    user, start, n = u, t, 0
                n += 1
            yield pd.DataFrame(rows, columns=["user_id", "window_start", "n", "refused"])
            rows = []
        if user is not None:
            yield pd.DataFrame([(user, start, n, max(0, n - most))], columns=["user_id", "window_start", "n", "refused"])

    return ordered.mapInPandas(fold, "user_id long, window_start timestamp, n long, refused long")


def rate_limited(events: DataFrame, seconds: int, most: int) -> DataFrame:
    """(user_id, event_id, allowed) of a stream: at most `most` events in each window, which begins with the first event after the last one."""

    def decide(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        start, n = state.get if state.exists else (0.0, 0)
        for batch in batches:
            rows = []
            for event, t in sorted(zip(batch.event_id, batch.ts, strict=True), key=lambda x: (x[1], x[0])):
                at = t.timestamp()
                if not n or at - start >= seconds:
                    start, n = at, 0
                n += 1
                rows.append((key[0], event, n <= most))
            yield pd.DataFrame(rows, columns=["user_id", "event_id", "allowed"])
        state.update((start, n))

    return events.where("user_id IS NOT NULL").groupBy("user_id").applyInPandasWithState(
        decide, "user_id long, event_id long, allowed boolean", "start double, n long", "append", GroupStateTimeout.NoTimeout
    )


def append_latest(stream: DataFrame, key: list[str], sequence: str, path: str, checkpoint: str, buckets: int = 64):
    """Start a query that keeps under `path` the latest record of each key that the stream has brought; read it with latest_table().

    Keys are hashed into buckets, each a snapshot of its own with an atomic pointer. A batch reads and writes only the
    buckets that it touches, under a version named by the batch, so one that is repeated after a failure writes the same again.
    """
    from acervo.operators.governance import heads
    from acervo.sources.snapshots import current_snapshot, publish_snapshot

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        marked = batch.withColumn("__bucket", F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int"))
        marked.persist()
        try:
            for bucket in sorted(r[0] for r in marked.select("__bucket").distinct().collect()):  # at most `buckets` numbers
                fresh = marked.where(F.col("__bucket") == bucket).drop("__bucket")
                held = current_snapshot(spark, f"{path}/{bucket}")
                together = fresh if held is None else held.select(*fresh.columns).unionByName(fresh)
                publish_snapshot(heads(together, key, sequence), f"{path}/{bucket}", f"batch-{number}")
        finally:
            marked.unpersist()

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_table(spark, path: str, buckets: int = 64) -> DataFrame | None:
    """The table that append_latest() keeps, all buckets together; None before the first batch."""
    from acervo.sources.snapshots import current_snapshot

    parts = [p for p in (current_snapshot(spark, f"{path}/{b}") for b in range(buckets)) if p is not None]
    out = parts[0] if parts else None
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
