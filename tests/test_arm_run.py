import datetime as dt
import json

import pytest

from chronolens.plans import arm_run, cli
from chronolens.plans.agent import Sample
from chronolens.plans.arm_ledger import ArmLedger

TODAY = dt.datetime(2020, 1, 1)
GROUPS = "day date, cik long, issuer_day_hash string, prompt string, events array<struct<event_id:string,packet_hash:string>>"
USE = json.dumps({"modelUsage": {"m": {"inputTokens": 1, "outputTokens": 2, "cacheReadInputTokens": 3, "cacheCreationInputTokens": 4, "costUSD": 0.01}}})


def grouped(spark, *names, extra=()):
    rows = [(dt.date(2026, 6, 1), k, n, "p " + n, [(f"{n}-{e}", "h") for e in (1, 2)] + [(x, "h") for x in extra if x.startswith(n)]) for k, n in enumerate(names)]
    return spark.createDataFrame(rows, GROUPS)


def ok(p=0.5, **more):
    return Sample("ok", p, 0.01, 10, "", "why", USE, {"seven_day": 0.1}, **more)


class Scripted:
    def __init__(self, *samples):
        self.samples, self.asked = list(samples), []

    def sample(self, group):
        self.asked.append(group["issuer_day_hash"])
        one = self.samples.pop(0)
        if isinstance(one, BaseException):
            raise one
        return one


@pytest.fixture(scope="module")
def own(spark, tmp_path_factory):
    return ArmLedger(spark, str(tmp_path_factory.mktemp("arm") / "ledger"))


def run(own, caller, groups, run_id="r1", **limits):
    return arm_run.ArmRun(own, caller, arm_run.Limits(**{"max_calls": 100, **limits}), run_id, "v1", "m").over(groups, TODAY)


def test_a_run_that_was_cut_off_spends_nothing_twice(spark, own):
    groups = grouped(spark, "a", "b")
    invalid = Sample("invalid_output", cost=0.01, tokens=10, payload=USE, windows={"seven_day": 0.1})
    with pytest.raises(KeyboardInterrupt):
        run(own, Scripted(ok(0.2), invalid, ok(0.4), KeyboardInterrupt()), groups)
    assert own.tokens_for_run("r1") == 30 and own.forecasts("v1").count() == 0
    other = Scripted()
    assert run(own, other, grouped(spark, "a"), "r2").claimed == 1 and other.asked == []
    again = Scripted(ok(0.6), invalid, Sample("refused", payload=USE, windows={"seven_day": 0.1}, detail="no"))
    report = run(own, again, groups)
    assert again.asked == ["a", "b", "b"] and (report.forecasts, report.exclusions, report.calls, report.halted) == (1, 1, 3, None)
    assert {r["event_id"]: float(r["estimate"]) for r in own.forecasts("v1").collect()} == {"a-1": pytest.approx(0.4), "a-2": pytest.approx(0.4)}
    assert [(r["reason"], r["n"]) for r in own.exclusion_counts("v1").collect()] == [("refused", 1)] and own.tokens_for_run("r1") == 60
    rest = run(own, Scripted(), grouped(spark, "a", "b", extra=("a-late",)))
    assert (rest.skipped, rest.changed, rest.calls) == (1, 1, 0)


def test_outages_and_limits_halt_before_the_next_group(spark, own):
    outage = Scripted(Sample("rate_limited", detail="until noon", windows={"seven_day": 0.2}))
    report = run(own, outage, grouped(spark, "c", "d"))
    assert report.halted == "rate_limited on issuer 0 (2026-06-01): until noon" and report.calls == 1
    assert run(own, Scripted(), grouped(spark, "c"), max_calls=5).halted == "call limit"
    assert run(own, Scripted(), grouped(spark, "c"), spend_ceiling=0.0).halted is not None
    silent = Sample("ok", 0.5, windows={})
    assert run(own, Scripted(silent, silent, silent), grouped(spark, "c", "d")).halted == "the last call reported no weekly usage"


def test_commands_run_captured_replies(spark, tmp_path, capsys):
    grouped(spark, "x").write.parquet(str(tmp_path / "groups"))
    replies = [("x", k, "ok", 0.3, "w", 0.01, 5, USE, 0.1) for k in range(3)]
    spark.createDataFrame(replies, "issuer_day_hash string, attempt long, status string, estimate double, rationale string, cost double, tokens long, payload string, weekly double").write.parquet(str(tmp_path / "replies"))
    common = ["--ledger", str(tmp_path / "l"), "--replies", str(tmp_path / "replies"), "--run-id", "r", "--prompt-version", "v", "--model", "m"]
    assert cli.main(["agent-pilot", "2026-06-01", str(tmp_path / "groups"), *common, "--scored-from", "2026-06-01"]) == 1
    assert "a pilot needs an earlier day" in capsys.readouterr().err
    assert cli.main(["agent-run", str(tmp_path / "groups"), *common, "--scored-from", "2026-06-01", "--end", "2026-06-02", "--max-calls", "20", "--store", str(tmp_path / "empty")]) == 1
    assert "2 trading days have no packets, the first: 2026-06-01" in capsys.readouterr().err
    assert cli.main(["agent-pilot", "2026-06-01", str(tmp_path / "groups"), *common, "--scored-from", "2026-07-01"]) == 0
    assert "'forecasts': 1" in capsys.readouterr().out
