"""Structured Streaming forms of the feed operators: publication feed, debounced ticks, expiry by timers, bounded intake."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.history import change_feed


def debounced(events: DataFrame, by: str, quiet: str = "75 milliseconds", late: str = "1 minute") -> DataFrame:
    """Ticks of a stream (by, ts): one row per burst, out once the watermark has passed its quiet time."""
    w = F.session_window("ts", quiet)
    return events.withWatermark("ts", late).groupBy(w.alias("w"), by).agg(F.count("*").alias("events")).select(by, F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "events")


def windowed_counts(events: DataFrame, by: str, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.window("ts", size).alias("w"), by).agg(F.count("*").alias("events")).select(by, F.col("w.start").alias("start"), "events")


def publication_feed(scans: DataFrame, read_last: Callable[[], DataFrame], write: Callable[[DataFrame, int], None]):
    """Each micro-batch of scanned rows (path, revision, status, bytes) against the last published ones: ``write(changes, batch)``.

    ``write`` must replace what it wrote for the same batch number, so a batch that runs again changes nothing.
    """

    def one(batch: DataFrame, number: int) -> None:
        write(change_feed(read_last(), batch.dropDuplicates(["path"])), number)

    return scans.writeStream.foreachBatch(one)


def expiring(rows: DataFrame, key: str, seconds: int, late: str = "1 minute") -> DataFrame:
    """Stream (key, ts) -> (key, expired_at): a row when a key hasn't been seen for ``seconds`` of event time."""
    limit = seconds * 1000

    def step(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            last = state.get[0]
            state.remove()
            yield pd.DataFrame({key: [k[0]], "expired_at": [pd.Timestamp(last + limit, unit="ms")]})
            return
        last = state.get[0] if state.exists else 0
        for p in parts:
            if len(p):
                last = max(last, int(p["ts"].max().value // 1_000_000))
        state.update((last,))
        state.setTimeoutTimestamp(max(last + limit, state.getCurrentWatermarkMs() + 1))

    return rows.withWatermark("ts", late).groupBy(key).applyInPandasWithState(
        step, f"{key} string, expired_at timestamp", "last long", "append", GroupStateTimeout.EventTimeTimeout
    )
