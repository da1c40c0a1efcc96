import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronolens.operators import metrics


def ranked(spark, x, y):
    return spark.createDataFrame([("d", float(a), float(b)) for a, b in zip(x, y, strict=True)], "day string, forecast double, abnormal_return double")


@pytest.mark.parametrize(
    ("x", "y", "want"),
    [(range(12), range(12), 1.0), (range(12), range(12)[::-1], -1.0), ([1] * 12, range(12), None), ([1, 2, 2, 4], [1, 3, 2, 4], 0.948683298)],
)
def test_rank_correlation(spark, x, y, want):
    got = metrics.information_coefficient(ranked(spark, x, y), ["day"]).first()["ic"]
    assert got is None if want is None else got == pytest.approx(want)


def daily(spark, values):
    return spark.createDataFrame([(k, v, 12) for k, v in enumerate(values)], "day int, ic double, n long")


@pytest.mark.parametrize(("values", "lags", "want"), [((1, 2, 3, 4), 1, 0.721688), ((0, 0, 0, 1, 1), 10, 0.153741)])
def test_newey_west_by_hand(spark, values, lags, want):
    got = metrics.newey_west(daily(spark, [float(v) for v in values]), lags).first()["nw_error"]
    assert got == pytest.approx(want, abs=2e-6)


def test_summary_takes_the_larger_error_and_needs_two_days(spark):
    whole = metrics.ic_summary(daily(spark, [1.0, 2.0, 3.0, 4.0]), lags=1).first()
    assert whole["error"] == pytest.approx(0.721688, abs=2e-6) and whole["significant"]
    one = metrics.ic_summary(daily(spark, [0.5, None])).first()
    assert (one["days"], one["mean_ic"], one["t"], one["significant"]) == (1, None, None, False)


def test_a_mean_without_error_is_infinite(spark):
    assert math.isinf(metrics.ic_summary(daily(spark, [0.5, 0.5])).first()["t"])


def test_brier_skill_per_row_reference(spark):
    rows = spark.createDataFrame([(0.6, 1.0, 0.5), (0.4, 0.0, 0.5), (0.5, 1.0, 0.9), (0.5, 0.0, 0.1)], "p double, y double, ref double")
    # the reference scores (.25 + .25 + .01 + .01) = .52, the forecasts (.16 + .16 + .25 + .25) = .82
    assert metrics.brier_skill(rows, F.col("ref")).first()["skill"] == pytest.approx(1 - 0.205 / 0.13)
    assert metrics.brier_skill(rows.withColumn("y", F.lit(1.0))).first()["skill"] is None


def test_calibration_uses_the_literal_edges(spark):
    rows = spark.createDataFrame([(p, 1.0) for p in (0.0, 0.3, 0.6, 0.7, 1.0)], "p double, y double")
    got = {r["band"]: r["n"] for r in metrics.calibration(rows).collect()}
    assert got == {0: 1, 2: 1, 5: 1, 6: 1, 9: 1}
    edges = np.linspace(0, 1, 11)
    assert list(edges) == list(metrics.CALIBRATION_EDGES)


def test_rose_is_the_sign_of_the_mean(spark):
    rows = spark.createDataFrame([("d", 1, 0.5, 0.05), ("d", 1, 0.7, -0.01), ("d", 2, 0.5, 0.0)], "day string, cik long, forecast double, abnormal_return double")
    got = {r["cik"]: (r["rose"], r["filings"]) for r in metrics.issuer_days(rows).collect()}
    assert got == {1: (1, 2), 2: (0, 1)}
