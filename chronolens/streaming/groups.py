"""Issuer-day groups of a filing stream: held until their window is over, released once, marked changed by what comes later.

A filing belongs to the group of its issuer and day; it was seen at some instant, and the watermark runs on that clock, so
a filing of an old day that is seen today is not late for Spark. A group is decided when its window closes, or when its
first filing is seen if that is later. Filings seen by then are its members and come out together as new; each one seen
afterwards comes out as changed: the group was decided without it. A filing that is seen twice counts once.

State is a group's filings until it is decided, then their ids for `remember` days, so that replays stay silent; a timer
removes them. Both timers run on event time, so a quiet group is released by the others' progress.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.ledger import DuplicateKeyError
from ..sources.commits import CommitLog, Field

DAY_MS = 86_400_000
OUTPUT = "cik long, day date, event_id long, state string, decided_at timestamp"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def decided_groups(filings: DataFrame, days: int) -> DataFrame:
    """The same rows from all filings at once (cik, day, event_id, seen_at)."""
    once = filings.groupBy("cik", "day", "event_id").agg(F.min("seen_at").alias("seen_at"))
    first = once.groupBy("cik", "day").agg(F.min("seen_at").alias("_first"))
    rows = once.join(first, ["cik", "day"]).withColumn("decided_at", F.greatest(F.date_add("day", days).cast("timestamp"), "_first"))
    return rows.withColumn("state", F.when(F.col("seen_at") <= F.col("decided_at"), "new").otherwise("changed")).select("cik", "day", "event_id", "state", "decided_at")


class GroupProcessor(StatefulProcessor):
    def __init__(self, days: int, remember: int):
        self.days, self.remember = days, remember

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getMapState("seen", "event_id long", "seen_ms long")
        self.decided = handle.getValueState("decided", "at_ms long, released boolean")

    def _closes(self, key: tuple) -> int:
        return int(pd.Timestamp(key[1]).value // 1_000_000) + self.days * DAY_MS

    def _row(self, key: tuple, event: int, state: str, at: int) -> tuple:
        return int(key[0]), key[1], event, state, pd.Timestamp(at, unit="ms")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        at, released = self.decided.get() if self.decided.exists() else (None, False)
        out = []
        for batch in rows:
            for event, seen in zip(batch["event_id"].tolist(), (batch["seen_at"].astype("datetime64[ns]").astype("int64") // 1_000_000).tolist(), strict=True):
                if self.seen.containsKey((event,)):
                    if not released and seen < self.seen.getValue((event,))[0]:
                        self.seen.updateValue((event,), (seen,))
                    continue
                self.seen.updateValue((event,), (seen,))
                if released:
                    out.append(self._row(key, event, "changed", at))
        if not released:
            now = max(self._closes(key), min(v[0] for v in self.seen.values()))
            if now != at:
                if at is not None:
                    self.handle.deleteTimer(at)
                self.handle.registerTimer(now)
                self.decided.update((now, False))
        yield pd.DataFrame(out, columns=["cik", "day", "event_id", "state", "decided_at"])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        out = []
        at, released = self.decided.get()
        if not released:
            self.decided.update((at, True))
            self.handle.registerTimer(at + self.remember * DAY_MS)
            out = [self._row(key, event[0], "new" if seen[0] <= at else "changed", at) for event, seen in sorted(self.seen.iterator())]
        else:
            self.seen.clear()
            self.decided.clear()
        yield pd.DataFrame(out, columns=["cik", "day", "event_id", "state", "decided_at"])

    def close(self) -> None:
        pass


def group_stream(filings: DataFrame, days: int, remember: int = 30, late: str = "0 seconds") -> DataFrame:
    """decided_groups() over a stream of cik, day, event_id and seen_at; rows come out as soon as the watermark allows."""
    filings.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    timed = filings.select("cik", "day", "event_id", F.col("seen_at").cast("timestamp").alias("seen_at")).withWatermark("seen_at", late)
    return timed.groupBy("cik", "day").transformWithStateInPandas(GroupProcessor(days, remember), OUTPUT, "Append", "EventTime")


def ledger_sink(log: CommitLog, name: str, table: str = "groups") -> Callable[[DataFrame, int], None]:
    """For foreachBatch: a batch's rows and its number are published in one commit, so a batch that is run again adds nothing."""
    known = log.tables()[1]
    if table not in known:
        log.declare(table, [Field(c, t) for c, t in (x.split() for x in OUTPUT.split(", "))], key=["cik", "day", "event_id"])
    if "batches" not in known:
        log.declare("batches", [Field("query", "string", False), Field("batch", "long", False)], key=["query", "batch"])

    def write(rows: DataFrame, batch: int) -> None:
        spark = rows.sparkSession
        done = log.read("batches").filter((F.col("query") == name) & (F.col("batch") == batch)).limit(1).count()
        if done:
            rows.write.format("noop").mode("overwrite").save()  # the state of the batch must still be computed
            return
        mark = spark.createDataFrame([(name, batch)], "query string, batch long")
        try:
            log.append({table: rows, "batches": mark})
        except DuplicateKeyError:
            # Another run of this query may have published the batch meanwhile; anything else is an error.
            if not log.read("batches").filter((F.col("query") == name) & (F.col("batch") == batch)).limit(1).count():
                raise

    return write
