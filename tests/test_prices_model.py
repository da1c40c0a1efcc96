import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from chronolens.functions import canonical
from chronolens.operators import features, prices, walkforward

DAY = dt.date(2026, 6, 1)


def bars(spark, symbol_days):
    rows = [(s, DAY + dt.timedelta(d), Decimal(100 + d), Decimal(101 + d), 10) for s, days in symbol_days.items() for d in days]
    return spark.createDataFrame(rows, "symbol string, session date, open decimal(18,6), close decimal(18,6), volume long")


def label(spark, own, base, event_day=0, horizon=2):
    pairs = spark.createDataFrame([("A", "M")], "symbol string, benchmark string")
    event = spark.createDataFrame([("e", "A", DAY + dt.timedelta(event_day))], "accession_no string, symbol string, day date")
    return prices.label_events(event, bars(spark, {"A": own, "M": base}), pairs, horizon).first()


def test_label_needs_one_session_more_than_the_horizon(spark):
    assert label(spark, range(4), range(4))["exit_session"] == DAY + dt.timedelta(3)
    assert label(spark, range(3), range(4))["reason"] == "issuer series too short"
    assert label(spark, range(4), range(3))["reason"] == "benchmark series too short"
    assert label(spark, [1, 2, 5], [1, 3, 4, 5])["reason"] == "too few common sessions"


def test_halt_moves_the_exit(spark):
    row = label(spark, [1, 2, 30], range(40))
    assert row["exit_session"] == DAY + dt.timedelta(30) and row["reason"] is None


def test_excess_return_is_rounded_half_even_at_twelve_places(spark):
    row = spark.range(1).select(prices.excess_return(*[F.lit(Decimal(x)) for x in ("3", "4", "7", "8")]).alias("r")).first()
    assert row["r"] == (Decimal(1) / 3 - Decimal(1) / 7).quantize(Decimal("0.000000000001"))


def test_entry_is_strictly_after_the_day(spark):
    assert label(spark, range(5), range(5), event_day=1)["entry_session"] == DAY + dt.timedelta(2)


def test_bars_from_json(spark):
    raw = spark.createDataFrame([('{"A":[{"t":"2026-08-03T04:00:00Z","o":1.1,"h":2,"l":1,"c":1.25,"v":7}],"B":[]}',)], "bars string")
    rows = prices.parse_bars(raw).collect()
    assert len(rows) == 1 and rows[0]["close"] == Decimal("1.25") and rows[0]["symbol"] == "A"


def test_exact_summary_matches_the_definition():
    closes = [Decimal(100 + (k * 7) % 13) for k in range(70)]
    volumes = [Decimal(k % 5) for k in range(70)]
    change, deviation, rank = canonical.market_summary(closes, volumes)
    assert change == ((closes[-1] - closes[-22]) / closes[-22]).quantize(canonical.PLACES)
    earlier = volumes[-63:-1]
    assert float(rank) == pytest.approx((sum(v < volumes[-1] for v in earlier) + sum(v == volumes[-1] for v in earlier) / 2) / 62)
    assert deviation > 0 and canonical.market_summary(closes[:5], volumes[:5]) == (None, None, None)


def test_hash_identity():
    a = {"b": Decimal("1.50"), "a": dt.datetime(2026, 1, 1, 5, tzinfo=dt.UTC)}
    b = {"a": dt.datetime(2026, 1, 1, 0, tzinfo=dt.timezone(dt.timedelta(hours=-5))), "b": Decimal("1.5")}
    assert canonical.content_hash(a) == canonical.content_hash(b)
    assert canonical.canonical_text({"x": Decimal("1E+2"), "é": None}) == '{"x":"100","é":null}'
    for bad in (1.5, dt.datetime(2026, 1, 1), {1, 2}, b"x"):
        with pytest.raises(canonical.UnhashableValueError):
            canonical.content_hash({"x": bad})


def test_holding_fraction(spark):
    cases = [(10, 30, False, 0.25, 1.0), (10, 30, True, 0.5, 1.0), (10, 10, True, 1.0, 1.0), (10, 5, True, 0.0, 0.0), (None, 5, False, 0.0, 0.0), (0, 5, False, 0.0, 0.0), (10, 0, False, 1.0, 1.0)]
    rows = spark.createDataFrame([c[:3] for c in cases], "s long, r long, buy boolean")
    share, known = features.holding_fraction(F.col("s"), F.col("r"), F.col("buy"))
    assert [tuple(r) for r in rows.select(share, known).collect()] == [c[3:] for c in cases]


def test_clustering_counts_peers_but_not_the_future(spark):
    t = dt.datetime(2026, 6, 1, 12, tzinfo=dt.UTC)
    rows = [("d", 1, t, "a"), ("d", 1, t, "b"), ("d", 1, t + dt.timedelta(hours=1), "a"), ("d", 2, t, "z")]
    df = spark.createDataFrame(rows, "day string, cik long, as_of timestamp, insider_name string")
    got = df.select("cik", "as_of", features.insiders_so_far(df).alias("n")).collect()
    assert sorted((r["cik"], r["n"]) for r in got) == [(1, 2.0), (1, 2.0), (1, 2.0), (2, 1.0)]
    with pytest.raises(features.UnsupportedDomainError):
        features.insiders_so_far(df.drop("insider_name"))


def walk_rows(spark, flip_after=None):
    rows = []
    for d in range(12):
        for i in range(12):
            up = (i * 5 + d) % 12 < 6
            signal = 1.0 if up else -1.0
            future = flip_after is not None and d + 1 >= flip_after
            rows.append((f"{d}-{i}", DAY + dt.timedelta(d), i, DAY + dt.timedelta(d + 1), signal, int(up != future), (0.1 if up else -0.1)))
    return spark.createDataFrame(rows, "accession_no string, day date, cik long, exit_session date, x double, outcome int, abnormal_return double")


def test_blocks_and_training_sets_end_before_the_block(spark):
    rows = walk_rows(spark)
    blocks = walkforward.walk_blocks(rows, 0.3, 4)
    assert [r["block"] for r in blocks.orderBy("day").collect()] == [None] * 4 + [0] * 4 + [1] * 4
    train = walkforward.training_rows(rows, blocks)
    assert train.filter("day >= block_start OR exit_session >= block_start").count() == 0
    assert train.filter("block = 0").select("day").distinct().count() == 3


def test_future_outcomes_do_not_reach_a_fit(spark):
    weights = []
    for flip in (None, 5):
        rows = walk_rows(spark, flip)
        train = walkforward.training_rows(rows, walkforward.walk_blocks(rows, 0.3, 4)).filter("block = 0")
        weights.append(walkforward.coefficients(walkforward.fit(train, ("x",)), ("x",))["x"])
    assert weights[0] == pytest.approx(weights[1]) and weights[0] > 0.5


def test_one_outcome_cannot_be_fitted(spark):
    rows = walk_rows(spark).withColumns({"outcome": F.lit(1), "weight": F.lit(1.0)})
    with pytest.raises(walkforward.DegenerateTrainingSetError):
        walkforward.fit(rows, ("x",))
    assert walkforward.days_needed(0.3) == 3
