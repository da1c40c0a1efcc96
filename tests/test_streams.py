import datetime as dt
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from chronolens.sources.commits import CommitLog
from chronolens.streaming import groups, hold

SCHEMA = "cik long, day date, event_id long, seen_at timestamp"
START = dt.datetime(2026, 3, 2)


def filings(seed, n):
    """Filings over ten days; one in five is seen days after its own day, a few twice."""
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        d = rng.randrange(10)
        seen = START + dt.timedelta(days=d + (rng.randrange(1, 12) if rng.random() < 0.2 else 0), seconds=rng.randrange(86_400))
        rows.append((rng.randrange(6), (START + dt.timedelta(days=d)).date(), k, seen))
    rows += [(c, d, e, s + dt.timedelta(hours=30)) for c, d, e, s in rows[:15]]
    return sorted(rows, key=lambda r: r[3])


def put(path, k, rows):
    path.mkdir(exist_ok=True)
    lines = [json.dumps({"cik": c, "day": d.isoformat(), "event_id": e, "seen_at": s.isoformat()}) for c, d, e, s in rows]
    (path / f"{k:04d}.json").write_text("\n".join(lines))
    os.utime(path / f"{k:04d}.json", (1_000_000 + k, 1_000_000 + k))  # files are read in the order of their times


def listed(df):
    return sorted((r["cik"], r["day"], r["event_id"], r["state"], r["decided_at"]) for r in df.collect())


def run(spark, source, checkpoint, sink, **options):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(source))
    query = groups.group_stream(stream, days=3).writeStream.foreachBatch(sink).option("checkpointLocation", str(checkpoint)).trigger(availableNow=True).start()
    query.awaitTermination(240)
    assert query.exception() is None


@pytest.fixture(scope="module")
def streamed(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("groups")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    rows = filings(8, 160)
    log = CommitLog(spark, str(root / "ledger"))
    sink = groups.ledger_sink(log, "insider")
    cut = len(rows) // 2
    for k in range(2):
        put(root / "in", k, rows[k * cut // 2 : (k + 1) * cut // 2])
    run(spark, root / "in", root / "c", sink)  # the query ends and starts again on its checkpoint
    early = listed(log.read("groups"))
    put(root / "in", 2, rows[cut:])
    put(root / "in", 3, [(99, dt.date(2026, 6, 1), 10_000, dt.datetime(2026, 6, 1))])
    put(root / "in", 4, [(99, dt.date(2026, 6, 2), 10_001, dt.datetime(2026, 6, 2))])
    run(spark, root / "in", root / "c", sink)
    yield root, rows, log, early
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_a_restarted_stream_gives_the_batch_result(spark, streamed):
    root, rows, log, early = streamed
    want = listed(groups.decided_groups(spark.createDataFrame(rows, SCHEMA), 3))
    got = [r for r in listed(log.read("groups")) if r[0] != 99]
    assert got == want and {r[3] for r in want} == {"new", "changed"} and 0 < len(early) < len(want) and set(early) <= set(want)


def test_a_batch_that_runs_again_adds_nothing(spark, streamed):
    root, rows, log, _ = streamed
    before, last = listed(log.read("groups")), log.tables()[0]
    done = log.read("batches").agg(F.max("batch")).first()[0]
    again = groups.ledger_sink(log, "insider")
    again(spark.createDataFrame([(1, dt.date(2026, 3, 2), 777, "new", START)], groups.OUTPUT), done)
    assert listed(log.read("groups")) == before and log.tables()[0] == last
    # A whole run from the start under the same name publishes nothing new either.
    run(spark, root / "in", root / "other", again)
    assert listed(log.read("groups")) == before


def test_counts_leave_out_rows_behind_the_watermark(spark, tmp_path):
    rows = [("a", "2026-03-02T01:00:00", 1.0), ("a", "2026-03-02T02:00:00", 2.0), ("b", "2026-03-02T03:00:00", 4.0)], [("a", "2026-03-09T01:00:00", 1.0)], [("a", "2026-03-20T00:00:00", 1.0)], [("a", "2026-03-02T05:00:00", 8.0)], [("a", "2026-04-20T00:00:00", 1.0)]
    (tmp_path / "in").mkdir()
    for k, part in enumerate(rows):
        (tmp_path / "in" / f"{k}.json").write_text("\n".join(json.dumps({"event_type": t, "ts": at, "value": v}) for t, at, v in part))
        os.utime(tmp_path / "in" / f"{k}.json", (1_000_000 + k, 1_000_000 + k))
    stream = spark.readStream.schema("event_type string, ts timestamp, value double").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    query = hold.daily_counts(stream).writeStream.format("memory").queryName("daily").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = sorted((r["day"].date().isoformat(), r["event_type"], r["n"], r["value"]) for r in spark.table("daily").collect())
    assert got == [("2026-03-02", "a", 2, 3.0), ("2026-03-02", "b", 1, 4.0), ("2026-03-09", "a", 1, 1.0), ("2026-03-20", "a", 1, 1.0)]
