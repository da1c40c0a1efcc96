import datetime as dt

import pytest
from pyspark.sql import functions as F

from chronolens.operators import packets
from chronolens.operators.guards import GuardError
from chronolens.plans import agent
from chronolens.sources import client


class Scripted:
    def __init__(self, *statuses):
        self.statuses = list(statuses)

    def sample(self, prompt):
        status = self.statuses.pop(0) if self.statuses else "ok"
        return agent.Sample(status, 0.5, 0.02, 100)


def test_three_samples_and_one_retry_each():
    report = agent.run_groups([("a", "p"), ("b", "p")], Scripted("ok", "invalid", "ok", "ok", "error", "error"))
    assert report.forecasts == {"a": 0.5} and report.excluded == {"b": "error"} and report.largest_tokens == 100
    assert agent.run_groups([("a", "p")], Scripted("rate_limited")).halted == "rate limited"
    assert agent.run_groups([("a", "p")], Scripted(), lambda r: "spend ceiling").halted == "spend ceiling"


def test_prompt_version_follows_its_parts():
    one = agent.prompt_version("t", {"a": 1}, "m", "high", "c")
    assert len(one) == 16 and one != agent.prompt_version("t", {"a": 2}, "m", "high", "c")
    with pytest.raises(agent.EnvironmentViolationError):
        agent.require_isolation({"tools": ["x"]}, {"tools": []})


def test_refused_symbols_are_isolated():
    def fetch(symbols):
        if "BAD" in symbols:
            raise client.RejectedError
        return {s: [1] for s in symbols}

    found, refused = client.tolerating([f"S{k}" for k in range(7)] + ["BAD"], fetch)
    assert len(found) == 7 and refused == ["BAD"]
    with pytest.raises(GuardError):
        client.tolerating(["BAD", "A"], fetch)


def test_pages_follow_their_tokens():
    book = {None: {"next_page_token": "x", "n": 1}, "x": {"next_page_token": None, "n": 2}}
    assert [p["n"] for p in client.pages(book.get)] == [1, 2]
    with pytest.raises(client.RecentWindowError):
        client.checked_window(dt.date(2026, 1, 1), dt.date(2026, 1, 5), dt.date(2026, 1, 5))


def test_history_is_built_once(spark, tmp_path):
    built = []
    build = lambda: built.append(1) or spark.range(3)
    for _ in range(2):
        assert client.cached(spark, str(tmp_path), [("a.zip", 1, 2)], build).count() == 3
    client.cached(spark, str(tmp_path), [("a.zip", 1, 3)], build)
    assert len(built) == 2


def test_packets_that_look_ahead_are_refused(spark):
    base = "event_id string, as_of timestamp, bars array<struct<session:date>>, comparables array<struct<resolved_at:timestamp>>, domain string, sections array<string>"
    close = dt.datetime(2026, 6, 1, 20, tzinfo=dt.UTC)
    good = spark.createDataFrame([("a", close, [(dt.date(2026, 6, 1),)], [], "insider", [])], base)
    packets.require(good)
    with pytest.raises(packets.LookaheadError):
        packets.require(good.withColumn("as_of", F.col("as_of") - F.expr("INTERVAL 1 SECOND")))
    with pytest.raises(packets.UnsupportedPacketError):
        packets.require(good.withColumn("domain", F.lit("redflag")))
