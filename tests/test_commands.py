import datetime as dt
import json
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronolens.sources.commits import CommitLog
from chronolens.operators import features, guards, ledger, walkforward
from chronolens.plans import cli, pipeline, report
from chronolens.plans.settings import SettingsError, load_settings
from chronolens.sources import readers, schemas
from chronolens.sources.store import Store


@pytest.fixture(scope="module")
def captured(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("captured")
    for day in ("2026-06-01", "2026-06-02"):
        for a, ticker in (("e1", "ABC"), ("e2", "ABC"), ("e3", "NEW")):
            row = {"accession_no": f"{a}-{day}", "company": "A Corp", "cik": 7, "aff10b5_one": False, "as_of": f"{day}T14:30:00+00:00", "reporting_owners": [],
                   "rows": [{"Code": "\tP\n", "Shares": "100", "Price": "600", "Value": "60000\u2028", "Ticker": ticker, "Issuer": "A Corp", "Insider": "Jo", "Position": "CEO"}]}
            (root / f"{day}-{a}.json").write_text(json.dumps(row))
    start = dt.date(2026, 1, 5)
    days = [start + dt.timedelta(k) for k in range(180) if (start + dt.timedelta(k)).weekday() < 5]
    bars = [(s, d, *[Decimal(100 + k % 7)] * 4, 1000 + k % 9) for k, d in enumerate(days) for s in ("ABC", "XLK")]
    spark.createDataFrame(bars, "symbol string, session date, open decimal(18,6), close decimal(18,6), low decimal(18,6), high decimal(18,6), volume long").write.parquet(str(root / "bars"))
    spark.createDataFrame([(7, "7372", "ABC")], "cik long, sic string, current string").write.parquet(str(root / "issuers"))
    return root


def test_a_backfill_ingests_labels_and_packs_every_day(spark, captured, capsys):
    store = str(captured / "store")
    common = ["--store", store, "--filings", f"{captured}/{{day}}-*.json", "--bars", f"{captured}/bars", "--issuers", f"{captured}/issuers", "--today", "2026-07-20"]
    assert cli.main(["backfill", "2026-06-01", "2026-06-02", "--packets", *common]) == 0
    assert "completed=['2026-06-01', '2026-06-02']" in capsys.readouterr().out
    assert cli.main(["backfill", "2026-06-01", "2026-06-02", "--packets", *common]) == 0
    assert "skipped=['2026-06-01', '2026-06-02']" in capsys.readouterr().out
    kept = Store(spark, store)
    assert {r["day"].isoformat(): r["complete"] for r in kept.complete(["insider"], packets=True).collect()} == {"2026-06-01": True, "2026-06-02": True}
    gone = kept.read("insider", "2026-06-01", schemas.EXCLUSION, "packet-exclusions").collect()
    assert [(r["accession_no"], r["reason"]) for r in gone] == [("e3-2026-06-01", "no price history for NEW before the event")]
    assert cli.main(["build-packets", "2026-06-01", "--store", store, "--bars", f"{captured}/bars"]) == 0
    assert "{'packets': 2, 'excluded': 1}" in capsys.readouterr().out


def test_single_commands_report_failures(spark, captured, capsys, monkeypatch):
    store = str(captured / "other")
    assert cli.main(["resolve", "2026-06-01", "--store", store, "--bars", f"{captured}/bars", "--issuers", f"{captured}/issuers", "--today", "2026-07-20"]) == 0
    assert cli.main(["build-packets", "2026-06-01", "--store", store, "--bars", f"{captured}/bars"]) == 1
    monkeypatch.delenv("SEC_USER_AGENT", raising=False)
    assert cli.main(["check"]) == 1 and "SEC_USER_AGENT" in capsys.readouterr().err
    monkeypatch.setenv("SEC_USER_AGENT", "Jo Doe jo@example.com")
    monkeypatch.setenv("STORE_ROOT", store)
    assert cli.main(["check"]) == 0 and cli.main(["ledger-up", str(captured / "ledger")]) == 0 and cli.main(["version"]) == 0
    log = CommitLog(spark, str(captured / "ledger"))
    assert set(schemas.LLM_CALL.fieldNames()) <= set(log.read("calls").columns) and cli.main(["ledger-up", str(captured / "ledger")]) == 0
    assert set(schemas.PREDICTION.fieldNames()) <= set(log.read("predictions").columns) and set(schemas.AGENT_EXCLUSION.fieldNames()) <= set(log.read("exclusions").columns)


def test_arms_are_compared(spark, tmp_path, capsys):
    rows = [(f"a{d}-{k}", dt.date(2026, 6, 1 + d), k, k / 20, float(k)) for d in range(3) for k in range(12)]
    base = spark.createDataFrame(rows, "accession_no string, day date, cik long, forecast double, abnormal_return double")
    base.write.parquet(str(tmp_path / "base"))
    base.select("accession_no", (-F.col("forecast")).alias("forecast")).write.parquet(str(tmp_path / "other"))
    assert cli.main(["agent-compare", str(tmp_path / "base"), str(tmp_path / "other"), "2026-06-01", "2026-06-30"]) == 0
    assert "'compared': 36, 'days': 3, 'base_ic': 1.0, 'other_ic': -1.0, 'difference': 2.0" in capsys.readouterr().out


def test_settings_name_all_that_is_wrong():
    with pytest.raises(SettingsError) as error:
        load_settings({"SEC_USER_AGENT": "nobody", "BROKER_URL": "https://paper-api.alpaca.markets.evil.com", "DAILY_SPEND_CEILING": "0"})
    assert all(name in str(error.value) for name in ("SEC_USER_AGENT", "STORE_ROOT", "BROKER_URL", "DAILY_SPEND_CEILING"))


def test_an_empty_trading_day_and_unread_covers_stop_the_day(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    nothing = readers.form4_filings(spark, _file(tmp_path, "n.json", {"accession_no": "x", "rows": []}))
    with pytest.raises(pipeline.OpenDayError):
        pipeline.ingest_day(store, nothing, "2026-06-01")
    assert pipeline.ingest_day(store, nothing, "2026-06-06")["events"] == 0  # a Saturday
    reports = spark.createDataFrame([(f"r{k}", 7, ["Item 5.02"], None) for k in range(6)], "accession_no string, cik long, items array<string>, text string")
    facts = readers.cover_facts(spark, _file(tmp_path, "f.json", {"accession_no": "r0", "rows": [{"concept": "dei:TradingSymbol", "value": "abc"}]}))
    with pytest.raises(guards.GuardError):
        pipeline.ingest_reports(store, reports, facts, "2026-06-01")


def _file(root, name, content):
    (root / name).write_text(json.dumps(content))
    return str(root / name)


def test_the_first_stored_label_counts(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    rows = [("a", Decimal(r), "XLK", 5, dt.date(2026, 6, 2), dt.date(2026, 6, 9), None) for r in ("0.5", "-0.5")] + [("b", Decimal("-0.1"), "XLK", 5, dt.date(2026, 6, 2), dt.date(2026, 6, 9), None)]
    store.replace(spark.createDataFrame(rows, schemas.LABEL).coalesce(1), "insider", "2026-06-01", schemas.LABEL, "labels")
    labels = store.read("insider", "2026-06-01", schemas.LABEL, "labels", position="position")
    got = features.with_outcomes(spark.createDataFrame([("a",), ("b",), ("c",)], "accession_no string"), labels).collect()
    assert {r["accession_no"]: (float(r["abnormal_return"]), r["outcome"]) for r in got} == {"a": (0.5, 1), "b": (-0.1, 0)}


def test_usage_must_be_stated(spark):
    whole = '{"modelUsage":{"a":{"inputTokens":1,"outputTokens":2,"cacheReadInputTokens":3,"cacheCreationInputTokens":4,"costUSD":"0.5"}}}'

    def usage(payload):
        return ledger.model_usage(spark.createDataFrame([(1, payload)], "run_id long, payload string")).collect()

    assert [tuple(r)[1:6] for r in usage(whole)] == [("a", 1, 2, 3, 4)]
    for payload, said in ((whole.replace('"outputTokens":2,', ""), "outputTokens"), (whole.replace(',"costUSD":"0.5"', ""), "costUSD"), ('{"modelUsage":{}}', "no model"), ("{}", "no model")):
        with pytest.raises(Exception, match=said):
            usage(payload)


def test_run_limits():
    room = {"calls": 0, "max_calls": 10, "weekly_share": 0.1, "max_share": 0.5, "spent": 0.0, "ceiling": 4.0, "worst_call": 0.1, "tokens": 0, "max_tokens": 100, "worst_tokens": 10}
    assert guards.within_run_limits(**room) is None
    for change, said in (({"calls": 5}, "call limit"), ({"weekly_share": 0.5}, "usage window"), ({"spent": 3.5}, "spend ceiling"), ({"tokens": 50}, "token ceiling")):
        assert guards.within_run_limits(**{**room, **change}) == said


def test_the_fit_is_the_minimum_of_its_objective(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((400, 3)) * [1, 5, 0.2] + [0, 2, -1]
    y = (rng.random(400) < 1 / (1 + np.exp(-(x[:, 0] - 0.3 * x[:, 1])))).astype(int)
    w = rng.uniform(0.2, 1, 400)
    model = walkforward.fit(spark.createDataFrame([(*map(float, r), int(o), float(v)) for r, o, v in zip(x, y, w, strict=True)], "a double, b double, c double, outcome int, weight double"), ("a", "b", "c"))
    mean = (w[:, None] * x).sum(0) / w.sum()
    z = (x - mean) / np.sqrt((w[:, None] * (x - mean) ** 2).sum(0) / w.sum())
    beta, bias = np.zeros(3), 0.0
    for _ in range(20_000):  # plain gradient descent on the same objective
        p = 1 / (1 + np.exp(-(z @ beta + bias)))
        beta, bias = beta - 0.004 * (z.T @ (w * (p - y)) + beta), bias - 0.004 * float((w * (p - y)).sum())
    assert model.weights == pytest.approx(tuple(beta), abs=1e-6) and model.intercept == pytest.approx(bias, abs=1e-6)


def test_report_sentences():
    row = {"brier_skill": -0.03, "brier_skill_scored_rate": -0.05, "fitted_base_rate": 0.5, "base_rate": 0.4}
    bands = [{"mean_p": 0.6, "mean_y": 0.5, "n": 10}, {"mean_p": 0.4, "mean_y": 0.45, "n": 2}]
    said = report.calibration(row, bands)
    assert "worth less" in said and "hindsight" in said and "run high by 0.075, although 1 of 2 bands" in said
    assert "scatter" in report.bias([{"mean_p": 0.5, "mean_y": 0.51, "n": 5}, {"mean_p": 0.6, "mean_y": 0.59, "n": 5}]) and report.bias([]) == ""
    assert report.calibration({**row, "brier_skill": float("nan")}, bands) == "Calibration cannot be judged."
    assert "little more" in report.calibration({**row, "brier_skill": 0.02}, bands) and "cannot be told" in report.verdict(0.01, 1.0)
