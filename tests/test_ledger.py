import datetime as dt
import json
import threading

import pytest
from pyspark.sql import functions as F

from chronolens.operators.ledger import DuplicateKeyError
from chronolens.plans import arm_ledger
from chronolens.sources.commits import AppendOnlyError, CommitLog, ConflictError, Field, LedgerError

PAIRS = [Field("k", "long", False), Field("v", "string")]


def pairs(spark, *rows):
    return spark.createDataFrame(list(rows), "k long, v string")


def listed(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture
def log(spark, tmp_path):
    made = CommitLog(spark, str(tmp_path / "ledger"))
    made.declare("t", PAIRS, key=["k"])
    return made


def folders(log, table="t"):
    import os

    path = f"{log.root}/{table}"
    return set(os.listdir(path)) if os.path.exists(path) else set()


def test_appends_are_whole_and_keys_are_taken_once(spark, log):
    assert log.append({"t": pairs(spark, (1, "a"), (2, "b"))}) == 2
    before = folders(log)
    for bad in (pairs(spark, (3, "c"), (1, "x")), pairs(spark, (4, "d"), (4, "d"))):
        with pytest.raises(DuplicateKeyError):
            log.append({"t": bad})
    with pytest.raises(LedgerError, match="k is null"):
        log.append({"t": pairs(spark, (5, "e"), (None, "f"))})
    with pytest.raises(LedgerError, match="no columns"):
        log.append({"t": pairs(spark, (5, "e")).withColumn("w", F.lit(1))})
    assert folders(log) == before and listed(log.read("t")) == [(1, "a"), (2, "b")]
    assert log.append({"t": pairs(spark)}) is None and log.tables()[0] == 2
    assert log.append({"t": pairs(spark, (3, "c"))}) == 3
    assert listed(log.read("t", version=2)) == [(1, "a"), (2, "b")] and log.read("t").count() == 3


def test_nothing_replaces_or_removes_what_was_published(spark, log):
    log.append({"t": pairs(spark, (1, "a"))})
    for change in (log.replace, log.delete):
        with pytest.raises(AppendOnlyError):
            change("t", pairs(spark, (1, "b")))
    assert log._publish(2, {"append": []}) is False and log.tables()[0] == 2
    assert log.verify() == len(log.read("t").inputFiles())
    pairs(spark, (9, "z")).coalesce(1).write.mode("append").parquet(f"{log.root}/t/{next(iter(folders(log)))}")
    with pytest.raises(AppendOnlyError):
        log.verify()


def meanwhile(log, monkeypatch, act):
    """Let another writer publish just before this one's first try."""
    real, once = log._publish, [act]

    def publish(version, entry):
        if once:
            once.pop()()
        return real(version, entry)

    monkeypatch.setattr(log, "_publish", publish)


def test_a_writer_that_was_overtaken_checks_again(spark, log, monkeypatch):
    other = CommitLog(spark, log.root)
    meanwhile(log, monkeypatch, lambda: other.append({"t": pairs(spark, (1, "theirs"))}))
    with pytest.raises(DuplicateKeyError):
        log.append({"t": pairs(spark, (1, "mine"), (2, "mine"))})
    assert listed(log.read("t")) == [(1, "theirs")] and len(folders(log)) == 1
    meanwhile(log, monkeypatch, lambda: other.append({"t": pairs(spark, (3, "theirs"))}))
    assert log.append({"t": pairs(spark, (4, "mine"))}) == 4 and listed(log.read("t")) == [(1, "theirs"), (3, "theirs"), (4, "mine")]
    meanwhile(log, monkeypatch, lambda: other.declare("t", [Field("w", "long")]))
    with pytest.raises(LedgerError, match="declared anew"):
        log.append({"t": pairs(spark, (5, "mine"))})
    monkeypatch.setattr(log, "_publish", lambda version, entry: False)
    with pytest.raises(ConflictError):
        log.append({"t": pairs(spark, (6, "mine"))})


def test_of_two_writers_racing_for_a_key_one_wins(spark, log):
    got, start = [], threading.Barrier(4)

    def write(own):
        mine = CommitLog(spark, log.root)
        start.wait()
        try:
            got.append(mine.append({"t": pairs(spark, (100, str(own)), (own, "own"))}))
        except DuplicateKeyError:
            got.append("refused")

    writers = [threading.Thread(target=write, args=(k,)) for k in range(4)]
    [w.start() for w in writers]
    [w.join() for w in writers]
    rows = listed(log.read("t"))
    assert sorted(map(str, got)) == ["2", "refused", "refused", "refused"] and len(rows) == 2 and (100, str(min(r[0] for r in rows))) in rows
    assert log.verify() == len(log.read("t").inputFiles())


def test_tables_of_one_append_are_published_together(spark, log):
    log.declare("u", [Field("n", "long", False)], checks=["n > 0"])
    with pytest.raises(LedgerError, match="n > 0"):
        log.append({"t": pairs(spark, (1, "a")), "u": spark.createDataFrame([(0,)], "n long")})
    assert log.read("t").count() == log.read("u").count() == 0
    assert log.append({"t": pairs(spark, (1, "a")), "u": spark.createDataFrame([(1,), (1,)], "n long")}) == 3
    assert (log.read("t").count(), log.read("u").count()) == (1, 2)


def test_files_of_all_declarations_are_one_table(spark, log):
    log.append({"t": pairs(spark, (1, "a"))})
    with pytest.raises(LedgerError, match="state a default"):
        log.declare("t", [Field("n", "long", False)])
    log.declare("t", [Field("n", "long", False, "0")])
    log.append({"t": spark.createDataFrame([(2, "b", 5)], "k long, v string, n long")})
    log.append({"t": pairs(spark, (3, "c"))})
    log.declare("t", [Field("tags", "array<string>")])
    log.append({"t": spark.createDataFrame([(4, "d", 1, ["x"])], "k long, v string, n long, tags array<string>")})
    assert listed(log.read("t")) == [(1, "a", 0, None), (2, "b", 5, None), (3, "c", 0, None), (4, "d", 1, ["x"])]
    assert listed(log.read("t", version=2)) == [(1, "a")]
    with pytest.raises(DuplicateKeyError):
        log.append({"t": pairs(spark, (1, "again"))})
    with pytest.raises(LedgerError, match="already"):
        log.declare("t", [Field("V", "long")])


def test_a_key_declared_later_must_hold_for_old_rows(spark, tmp_path):
    log = CommitLog(spark, str(tmp_path / "l"))
    log.declare("t", PAIRS)
    log.append({"t": pairs(spark, (1, "a"), (1, "b"))})
    with pytest.raises(DuplicateKeyError):
        log.declare("t", key=["k"])
    log.declare("t", key=["k", "v"])
    with pytest.raises(DuplicateKeyError):
        log.append({"t": pairs(spark, (1, "b"))})


def forecast(spark, version, *events):
    rows = [(e, "m", version, "h" * 64, "d-" + e, 5, [0.5, 0.6, 0.7], ["r"] * 3, str(p)) for e, p in events]
    return spark.createDataFrame(rows, "event_id string, model string, prompt_version string, packet_hash string, issuer_day_hash string, horizon_days long, samples array<double>, rationales array<string>, estimate string")


def exclusion(spark, version, group, events=("x",), detail="d" * 3000):
    return spark.createDataFrame([(dt.date(2026, 7, 1), 42, group, version, "refused", 1, list(events), detail)], "event_day date, cik long, issuer_day_hash string, prompt_version string, reason string, samples_valid long, event_ids array<string>, detail string")


def test_the_arm_reads_back_what_it_wrote(spark, tmp_path):
    log = CommitLog(spark, str(tmp_path / "l"))
    assert arm_ledger.upgrade(log, 1) == 2
    calls = "run_id string, model string, input long, output long, cache_read long, cost_usd string"
    log.append({"calls": spark.createDataFrame([("r1", "m", 1, 2, 3, "0.5")], calls)})
    log.append({"predictions": forecast(spark, "v0", ("old", 0.4)).withColumn("arm", F.lit("agent"))})
    assert arm_ledger.upgrade(log) == 6 and arm_ledger.upgrade(log) == 0
    own = arm_ledger.ArmLedger(spark, log.root)
    own.write_forecasts(forecast(spark, "v1", ("e1", 0.25), ("e2", 0.75)))
    with pytest.raises(DuplicateKeyError):
        own.write_forecasts(forecast(spark, "v1", ("e3", 0.1), ("e1", 0.2)))
    events = spark.createDataFrame([("e1",), ("e2",), ("e3",)], "event_id string")
    assert listed(own.predicted("v1", events)) == [("e1",), ("e2",)] and own.predicted("v2", events).count() == 0
    assert {r["event_id"]: float(r["estimate"]) for r in own.forecasts("v1").collect()} == {"e1": 0.25, "e2": 0.75}
    own.write_exclusions(exclusion(spark, "v1", "g1", ("e3", "e4")))
    with pytest.raises(DuplicateKeyError):
        own.write_exclusions(exclusion(spark, "v1", "g1"))
    own.write_exclusions(exclusion(spark, "v2", "g1"))
    assert own.is_excluded("v1", "g1") and not own.is_excluded("v1", "g2") and listed(own.exclusion_counts("v1")) == [("refused", 1)]
    assert listed(own.excluded_events("v1", events)) == [("e3",)] and len(log.read("exclusions").first()["detail"]) == 2000
    use = {"modelUsage": {"m": {"inputTokens": 2, "outputTokens": 3, "cacheReadInputTokens": 4, "cacheCreationInputTokens": 14154, "costUSD": 0.0631785}}}
    own.record_calls(spark.createDataFrame([("r1", "g1", json.dumps(use)), ("r2", "g1", json.dumps(use))], "run_id string, issuer_day_hash string, payload string"))
    assert own.tokens_for_run("r1") == 6 + 14163 and own.tokens_for_run("r2") == 14163 and own.tokens_for_run("r3") == 0
    assert float(own.spent_since(F.lit(dt.datetime(2000, 1, 1))).first()[0]) == pytest.approx(0.5 + 2 * 0.063179, abs=2e-6)
    assert float(own.spent_since(F.current_timestamp() + F.expr("INTERVAL 1 DAY")).first()[0]) == 0
    old = log.read("calls").filter("run_id = 'r1' AND input = 1").first()
    assert (old["issuer_day_hash"], old["cache_write"], old["session_id"]) == (None, 0, "")
    with pytest.raises(LedgerError, match="horizon_days"):
        own.write_forecasts(forecast(spark, "v1", ("e9", 0.5)).withColumn("horizon_days", F.lit(0)))
