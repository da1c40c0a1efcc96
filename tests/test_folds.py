import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from chronolens.operators import metrics, walkforward

DAY = dt.date(2026, 1, 5)


def events(spark, seed, n, days):
    """Filings with outcomes that close up to twelve days later, several an issuer-day, and a feature that is constant for long."""
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        d = rng.randrange(days)
        signal = rng.gauss(100, 3)
        up = rng.random() < 1 / (1 + 2.718 ** (-(signal - 100) / 3))
        rows.append((k, DAY + dt.timedelta(d), None if rng.random() < 0.02 else rng.randrange(9), DAY + dt.timedelta(d + rng.randrange(13)), signal, 1.0 if d < 3 * days // 4 else rng.random(), int(up), rng.uniform(0, 0.2) * (1 if up else -1)))
    return spark.createDataFrame(rows, "accession_no long, day date, cik long, exit_session date, x double, c double, outcome int, abnormal_return double")


@pytest.fixture(scope="module")
def folds(spark):
    rows = events(spark, 4, 900, 40).persist()
    return rows, walkforward.walk_blocks(rows, 0.3, 5)


def test_each_event_is_held_once_with_the_weights_of_all_its_blocks(spark, folds):
    rows, blocks = folds
    held = walkforward.fold_rows(rows, blocks)
    copies = walkforward.training_rows(rows, blocks)
    assert held.count() == held.select("accession_no").distinct().count() == copies.select("accession_no").distinct().count() < copies.count()
    want = {(r["block"], r["accession_no"]): r["weight"] for r in copies.collect()}
    count = blocks.filter("block IS NOT NULL").select("block").distinct().count()
    got = {}
    for r in held.collect():
        for k, step in enumerate(r["steps"]):
            until = r["steps"][k + 1]["block"] if k + 1 < len(r["steps"]) else count
            got |= {(b, r["accession_no"]): step["weight"] for b in range(step["block"], until)}
    assert got == want and count > 4


def test_fits_and_rates_equal_those_of_copied_training_sets(spark, folds):
    rows, blocks = folds
    held, copies = walkforward.fold_rows(rows, blocks), walkforward.training_rows(rows, blocks).persist()
    count = blocks.filter("block IS NOT NULL").select("block").distinct().count()
    models = walkforward.fit_folds(held, count, ("x", "c"))
    for b in (0, 2, count - 1):
        one = walkforward.fit(copies.filter(F.col("block") == b), ("x", "c"))
        for name in ("means", "scales", "weights"):
            assert getattr(models[b], name) == pytest.approx(getattr(one, name), rel=1e-8, abs=1e-9)
        assert models[b].intercept == pytest.approx(one.intercept, abs=1e-9)
    days = metrics.issuer_days(copies.withColumn("forecast", F.lit(0.0)), ["block", "day", "cik"])
    want = days.groupBy("block").agg(F.avg("rose").alias("rate"), F.sum("filings").alias("n"), F.count(F.lit(1)).alias("days"))
    got = walkforward.fold_days(held, blocks).orderBy("block").collect()
    assert [(r["block"], pytest.approx(r["rate"]), r["n"], r["days"]) for r in want.orderBy("block").collect()] == [tuple(r) for r in got]
    sizes = {(r["block"], r["day"]): r["rows"] for r in walkforward.fold_sizes(held, blocks).collect()}
    assert sizes == {(r["block"], r["day"]): r["count"] for r in copies.groupBy("block", "day").count().collect()}


def test_small_batches_change_nothing(spark, folds, monkeypatch):
    rows, blocks = folds
    held = walkforward.fold_rows(rows, blocks).coalesce(1)
    whole = walkforward.fit_folds(held, 6, ("x", "c"))
    monkeypatch.setattr(walkforward, "BATCH_ROWS", 7)
    # The workers run their own copy of the module, so the bound is also tried directly.
    import pyarrow as pa

    steps = pa.array([[{"block": 0, "weight": 1.0}, {"block": 2, "weight": 0.5}], [{"block": 1, "weight": 0.25}]])
    assert walkforward._weights(steps, 4).tolist() == [[1.0, 1.0, 0.5, 0.5], [0.0, 0.25, 0.25, 0.25]]
    for b, model in walkforward.fit_folds(held, 6, ("x", "c")).items():
        assert model.weights == pytest.approx(whole[b].weights, abs=1e-9)


def test_a_fold_with_one_outcome_or_none_cannot_be_fitted(spark, folds):
    rows, blocks = folds
    with pytest.raises(walkforward.DegenerateTrainingSetError):
        walkforward.fit_folds(walkforward.fold_rows(rows.withColumn("outcome", F.lit(1)), blocks), 6, ("x",))
    with pytest.raises(walkforward.DegenerateTrainingSetError):
        walkforward.fit_folds(walkforward.fold_rows(rows.limit(0), blocks), 6, ("x",))
