import datetime as dt
import json
from decimal import Decimal

import pytest

from chronolens.functions import canonical
from chronolens.operators.guards import GuardError
from chronolens.plans import pipeline
from chronolens.plans.backfill import WindowsStillOpenError
from chronolens.sources import readers, schemas
from chronolens.sources.store import Store

DAY, TODAY = "2026-06-01", dt.date(2026, 7, 1)


@pytest.fixture(scope="module")
def day(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("day")
    rows = [
        {"accession_no": a, "company": "A Corp", "cik": cik, "aff10b5_one": False, "as_of": f"2026-06-01T{hour}:30:00+00:00", "reporting_owners": [],
         "rows": [{"Code": "P", "Shares": "100", "Price": "600", "Value": "60000", "Ticker": ticker, "Issuer": "A Corp", "Insider": "Jo", "Position": "CEO"}]}
        for a, cik, ticker, hour in (("e1", 7, "ABC", "14"), ("e2", 7, "ABC", "21"), ("e3", 8, "NEW", "14"))
    ]
    for k, r in enumerate(rows):
        (root / f"{k}.json").write_text(json.dumps(r))
    start = dt.date(2026, 1, 5)
    days = [start + dt.timedelta(k) for k in range(180) if (start + dt.timedelta(k)).weekday() < 5]
    bars = [(s, d, Decimal(100 + k % 7 + (k if s == "ABC" else 0)), Decimal(101 + k % 5 + (k if s == "ABC" else 0)), 1000 + k % 9) for k, d in enumerate(days) for s in ("ABC", "XLK", "SPY")]
    table = spark.createDataFrame([(s, d, o, c, o, c, v) for s, d, o, c, v in bars], "symbol string, session date, open decimal(18,6), close decimal(18,6), low decimal(18,6), high decimal(18,6), volume long")
    issuers = spark.createDataFrame([(7, "7372", "ABC"), (8, "n/a", None)], "cik long, sic string, current string")
    store = Store(spark, str(root / "store"))
    counts = pipeline.ingest_day(store, readers.form4_filings(spark, str(root / "*.json")), DAY)
    return store, table, issuers, counts


def test_a_day_is_held_until_its_windows_close(day):
    store, bars, issuers, _ = day
    with pytest.raises(WindowsStillOpenError):
        pipeline.resolve_day(store, "insider", DAY, bars, issuers, dt.date(2026, 6, 9))
    assert not store.exists("insider", DAY, "labels")


def test_labels_and_exclusions_account_for_every_event(day):
    store, bars, issuers, counts = day
    assert counts == {"events": 3, "rejected": 0, "unpriceable": 0}
    assert pipeline.resolve_day(store, "insider", DAY, bars, issuers, TODAY) == {"labels": 2, "excluded": 1}
    labels = {r["accession_no"]: r for r in store.read("insider", DAY, schemas.LABEL, "labels").collect()}
    assert labels["e1"]["benchmark_symbol"] == "XLK" and labels["e1"]["entry_session"] == dt.date(2026, 6, 2)
    assert labels["e1"]["exit_session"] == dt.date(2026, 6, 9) and labels["e1"]["horizon_days"] == 5
    gone = store.read("insider", DAY, schemas.EXCLUSION, "label-exclusions").collect()
    assert [(r["accession_no"], r["ticker"]) for r in gone] == [("e3", "NEW")]


def test_a_missing_benchmark_stops_the_day(day):
    store, bars, issuers, _ = day
    with pytest.raises(GuardError):
        pipeline.resolve_day(store, "insider", DAY, bars.filter("symbol <> 'XLK'"), issuers, TODAY)


def test_packets_hold_closed_bars_only(day, spark):
    store, bars, _, _ = day
    rows = store.read("insider", DAY, schemas.INSIDER_EVENT)
    packets = {r["accession_no"]: r for r in pipeline.build_packets(store, rows, bars, DAY).collect()}
    last = {a: json.loads(p["canonical"])["bars"][-1]["session"] for a, p in packets.items()}
    assert last == {"e1": "2026-05-29", "e2": "2026-06-01"}  # 14:30 and 21:30 UTC, either side of the close
    one = json.loads(packets["e1"]["canonical"])
    closes, volumes = [Decimal(b["close"]) for b in one["bars"]], [Decimal(b["volume"]) for b in one["bars"]]
    change, deviation, rank = canonical.market_summary(closes, volumes)
    assert one["summary"] == canonical.canonical({"trailing_return": change, "realised_volatility": deviation, "volume_midrank": rank})
    stored = store.read_packets("insider", DAY)
    assert {r["content_hash"] for r in stored.collect()} == {p["content_hash"] for p in packets.values()}


def test_red_flag_reports_get_their_own_ticker(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    reports = spark.createDataFrame([("r1", 7, ["Item 5.02(b)"], None), ("r2", 7, ["Item 9.01"], "x")], "accession_no string, cik long, items array<string>, text string")
    (tmp_path / "f.json").write_text(json.dumps({"accession_no": "r1", "rows": [
        {"concept": c, "value": v, "context_ref": "c", "is_dimensioned": False, "entity_identifier": "7", "dimensions": {}} for c, v in (("dei:TradingSymbol", "abc"), ("dei:Security12bTitle", "Common Stock"))]}))
    assert pipeline.ingest_reports(store, reports, readers.cover_facts(spark, str(tmp_path / "f.json")), DAY) == {"events": 1}
    row = store.read("redflag", DAY, schemas.REDFLAG_EVENT).first()
    assert (row["ticker"], row["ticker_source"], row["item_text"], row["item_codes"]) == ("ABC", "filing", "", ["5.02"])
