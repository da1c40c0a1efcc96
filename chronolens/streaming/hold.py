"""Streaming form of hold-until-closed: events wait in state until their outcome window is over."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OUTPUT = "key long, event_id long, closes_at timestamp"
STATE = "ids array<long>, closes array<long>"


def daily_counts(stream: DataFrame, late: str = "1 day", time: str = "ts", key: str = "event_type") -> DataFrame:
    """Events a day and key; rows later than the watermark are left out, as a day already reported is."""
    timed = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    counts = timed.groupBy(F.window(time, "1 day"), key).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value"))
    return counts.select(F.col("window.start").alias("day"), key, "n", "value")


def hold_until_closed(stream: DataFrame, days: int, key: str = "user_id", time: str = "ts", event: str = "event_id", late: str = "0 seconds") -> DataFrame:
    """Each event once the watermark has passed its time by `days`; until then it is state of its key."""
    timed = stream.select(F.col(key).alias("key"), F.col(event).alias("event_id"), F.col(time).cast("timestamp").alias("at")).withWatermark("at", late)
    span = days * 86_400_000

    def release(k: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        ids, closes = (list(x) for x in state.get) if state.exists else ([], [])
        for batch in batches:
            ids += batch["event_id"].tolist()
            closes += [int(t.timestamp() * 1000) + span for t in batch["at"]]
        now = state.getCurrentWatermarkMs()
        out = [(k[0], i, pd.Timestamp(c, unit="ms")) for i, c in zip(ids, closes, strict=True) if c <= now]
        left = [(i, c) for i, c in zip(ids, closes, strict=True) if c > now]
        if left:
            state.update(([i for i, _ in left], [c for _, c in left]))
            state.setTimeoutTimestamp(max(min(c for _, c in left), now + 1))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=["key", "event_id", "closes_at"])

    return timed.groupBy("key").applyInPandasWithState(release, OUTPUT, STATE, "append", "EventTimeTimeout")
