import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from chronolens.operators import breakdowns, events, ledger
from chronolens.plans import backfill, pipeline, report
from chronolens.sources import archives, readers, schemas
from chronolens.sources.store import PacketIntegrityError, Store
from chronolens.streaming import hold

ROW = {"Code": "P", "Shares": "100", "Price": "5.5", "Value": "550", "Remaining Shares": "900", "Date": "2026-06-01", "Ticker": "abc", "Issuer": "A Corp", "Insider": "Jo", "Position": "CEO"}


def filing(accession, rows, **more):
    return {"accession_no": accession, "company": "A Corp", "cik": 7, "aff10b5_one": False, "as_of": "2026-06-01T14:30:00+00:00", "reporting_owners": [{"cik": "0000000009"}, {"cik": "3"}], "rows": rows, **more}


def filings(tmp_path, *all_):
    for k, f in enumerate(all_):
        (tmp_path / f"{k}.json").write_text(json.dumps(f))
    return str(tmp_path)


def test_events_of_captured_filings(spark, tmp_path):
    path = filings(
        tmp_path,
        filing("joint", [ROW, {**ROW, "Position": "Director"}, {**ROW, "Shares": "100.0"}]),
        filing("identity", [{"Issuer": "A Corp", "Ticker": "abc"}]),
        filing("bad", [ROW, {**ROW, "Shares": "1,000"}]),
        filing("unlisted", [{**ROW, "Ticker": "N/A"}]),
        filing("gift", [{**ROW, "Code": "G", "Price": "0", "Value": None}]),
        filing("late", [ROW], as_of=None),
    )
    found, lost = readers.insider_events(readers.form4_filings(spark, path))
    rows = found.collect()
    assert sorted(r["accession_no"] for r in rows) == ["gift", "joint", "joint"]
    assert {r["accession_no"]: r["reason"] for r in lost.collect()} == {"bad": "unreadable cell", "unlisted": "unpriceable issuer", "late": "no acceptance time"}
    assert rows[0]["owner_ciks"] == [3, 9] and rows[0]["ticker"] == "ABC"


def test_a_day_is_replaced_and_an_empty_one_is_known(spark, tmp_path):
    path = filings(tmp_path / "in" if (tmp_path / "in").mkdir() is None else tmp_path, *[filing(str(k), [{**ROW, "Value": "60000"}]) for k in range(3)])
    rows, store = readers.form4_filings(spark, path), Store(spark, str(tmp_path / "store"))
    assert pipeline.ingest_day(store, rows, "2026-06-01") == {"events": 3, "rejected": 0, "unpriceable": 0}
    assert store.read("insider", "2026-06-01", schemas.INSIDER_EVENT).filter("owner_ciks[0] = 3").count() == 3
    pipeline.ingest_day(store, rows, "2026-06-01", floor=1e9)
    assert store.read("insider", "2026-06-01", schemas.INSIDER_EVENT).count() == 0 and store.exists("insider", "2026-06-01")
    with pytest.raises(FileNotFoundError):
        store.read("insider", "2026-06-02", schemas.INSIDER_EVENT)
    assert [r["day"].isoformat() for r in store.days("insider").collect()] == ["2026-06-01"]
    assert not store.complete(["insider"]).first()["complete"]


def test_packets_round_trip(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    packets = spark.createDataFrame([('{"a":1,"b":"é"}',)], "canonical string")
    store.write_packets(packets, "insider", "2026-06-01")
    assert len(store.read_packets("insider", "2026-06-01").first()["content_hash"]) == 64
    store.write_packets(packets.select(F.lit('{"b":1,"a":2}').alias("canonical")), "insider", "2026-06-02")
    with pytest.raises(PacketIntegrityError):
        store.read_packets("insider", "2026-06-02")


def test_history_archives(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "2024q1_form345.zip", "w") as z:
        for name, lines in {
            "SUBMISSION": ["ACCESSION_NUMBER\tFILING_DATE\tDOCUMENT_TYPE\tISSUERCIK", 'a\t06-MAR-2024\t4\t7', "b\t07-MAR-2024\t5\t7", "c\tjunk\t4/A\t7", "d\t08-MAR-2024\t4/A\t7"],
            "NONDERIV_TRANS": ["ACCESSION_NUMBER\tTRANS_DATE\tTRANS_CODE", "a\t05-MAR-2024\tP", "a\t31-FEB-2024\tS", "a\t09-MAR-2024\tS", "b\t05-MAR-2024\tP", 'd\t01-JAN-2021\tS"', "d\t02-JAN-2021\tS"],
            "REPORTINGOWNER": ["ACCESSION_NUMBER\tRPTOWNERCIK", "a\t0001", "a\t2", "d\t1", "d\tx", "b\ty"],
        }.items():
            buffer = io.StringIO("\n".join(lines))
            z.writestr(f"{name}.tsv", buffer.getvalue())
    history = readers.history_archives(spark, f"{tmp_path}/*_form345.zip")
    trades, skipped = breakdowns.history_trades(**{k: v.drop("quarter") for k, v in history.items()})
    assert sorted((r["owner"], r["year"], r["month"]) for r in trades.collect()) == [(1, 2021, 1), (1, 2024, 3), (2, 2024, 3)]
    assert tuple(skipped.first()) == (3, 1) and tuple(readers.quarters(history).first()) == ("2024q1", "2024q1")


def test_cover_page_symbols(spark, tmp_path):
    fact = lambda c, v, ctx, member=None: {"concept": c, "value": v, "context_ref": ctx, "is_dimensioned": bool(member), "entity_identifier": "7", "dimensions": {"dei:LegalEntityAxis": member} if member else {}}
    rows = [fact("dei:TradingSymbol", "abc", "c1"), fact("dei:Security12bTitle", "Common Stock", "c1"), fact("dei:Security12bTitle", "Notes", "c1"), fact("dei:TradingSymbol", "SUB", "c2", "m"), fact("dei:EntityCentralIndexKey", "0000000008", "c3", "m")]
    (tmp_path / "f.json").write_text(json.dumps({"accession_no": "x", "rows": rows}))
    got = {r["symbol"]: (r["title"], r["entity_cik"]) for r in events.cover_securities(readers.cover_facts(spark, str(tmp_path))).collect()}
    assert got == {"abc": ("Common Stock", 7), "SUB": (None, 8)}


def test_ledger_refuses_a_second_forecast(spark, tmp_path):
    key = ["event_id", "arm"]
    old = spark.createDataFrame([("e1", "a", 0.5)], "event_id string, arm string, estimate double")
    new = spark.createDataFrame([("e2", "a", 0.4)], old.schema)
    assert ledger.append_unique(old, new, key, str(tmp_path / "l")).count() == 2 and spark.read.parquet(str(tmp_path / "l")).count() == 1
    for bad in (old, new.unionByName(new)):
        with pytest.raises(ledger.DuplicateKeyError):
            ledger.append_unique(old, bad, key, str(tmp_path / "l"))
    assert spark.read.parquet(str(tmp_path / "l")).count() == 1


def test_archives_are_read_member_by_member(spark, tmp_path, monkeypatch):
    for quarter, rows in (("2024q1", ["1\tone \"x\t\u00e9", "", "2"]), ("2024q2", ["3\tthree\tc\tmore"])):
        with zipfile.ZipFile(tmp_path / f"{quarter}_form345.zip", "w") as z:
            z.writestr("M.tsv", b"\xff".join([("A\tB\tC\r\n" + "\r\n".join(rows) + "\t").encode(), b"\r\n"]))
            z.writestr("OTHER.tsv", "A\n")
    spark.dataSource.register(archives.ArchiveMembers)
    load = lambda schema, member="M", pattern="*_form345.zip": spark.read.format("tsv_archives").schema(schema).option("member", member).load(f"{tmp_path}/{pattern}")
    whole = load("B string, quarter string, A string, C string")
    assert sorted(map(tuple, whole.collect()), key=lambda r: r[2]) == [('one "x', "2024q1", "1", "\u00e9"), ("\ufffd", "2024q1", "2", None), ("three", "2024q2", "3", "c")]
    assert whole.rdd.getNumPartitions() == 2 and sorted(r["C"] or "" for r in load("C string").collect()) == ["", "c", "\u00e9"]
    assert load("quarter string").count() == 3 and load("A string", pattern="*_none.zip").count() == 0 and load("A string", "OTHER").count() == 0
    monkeypatch.setattr(archives, "BATCH_ROWS", 1)
    with open(tmp_path / "2024q1_form345.zip", "rb") as file:
        assert [b for b in archives.member_rows(file, "M", ["A"])] == [[["1"]], [["2"]]]
    for bad in (lambda: load("Z string").count(), lambda: load("A string", "GONE").count(), lambda: load("A long").count()):
        with pytest.raises(Exception, match="has no|must be read"):
            bad()


def test_backfill_skips_retries_holds_and_stops():
    tries, waits = {"r": 0}, []

    def run(day):
        if day == "r" and (tries.update(r=tries["r"] + 1) or tries["r"] < 3):
            raise backfill.TransportError("down")
        if day == "open":
            raise backfill.WindowsStillOpenError(day)
        if day.startswith("bad"):
            raise ValueError("broken")

    report_ = backfill.backfill(["done", "r", "open", "a", "b", "c", "bad"], {"done"}, run, waits.append)
    assert (report_.completed, report_.skipped, report_.pending, list(report_.failed), waits) == (["r", "a", "b", "c"], ["done"], ["open"], ["bad"], [5.0, 10.0])
    with pytest.raises(backfill.GuardError):
        backfill.backfill(["a", "b", "bad", "bad2"], set(), run, waits.append)


def test_report_sections():
    rows = [{"bucket": k, "days": 5, "issuer_days": 60, "mean_ic": 0.01 * k, "error": 0.01, "t": float(k)} for k in range(3)]
    account = {"total": 200, "in_rows": 180, "dropped": 15, "ungrouped": 5}
    text = report.group_section("By size", rows, account, "bucket")
    assert "200 issuer-days = 180 in rows + 15 dropped + 5 without group." in text and "Only 2 reaches" in text
    assert "Omitted" in report.group_section("By size", [], account, "bucket") and report.signed(float("nan")) == "n/a"


def test_events_are_held_until_their_window_closes(spark, tmp_path):
    source, name = tmp_path / "in", "held"
    schema = "event_id long, ts timestamp, user_id long, event_type string, value double"
    one = spark.createDataFrame([(1, "2024-01-01 10:00:00", 5), (2, "2024-01-02 10:00:00", 5), (3, "2024-01-09 00:00:00", 6)], "event_id long, t string, user_id long")
    one.select("event_id", F.to_timestamp("t").alias("ts"), "user_id", F.lit("click").alias("event_type"), F.lit(1.0).alias("value")).write.parquet(str(source))
    stream = spark.readStream.schema(schema).parquet(str(source))
    query = hold.hold_until_closed(stream, days=5).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    assert sorted(r["event_id"] for r in spark.table(name).collect()) == [1, 2]
