"""Queries over forecast statistics, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import metrics
from .roles import FILINGS, JUDGED, SCORES, filings, ic_sql, judged


def nine(*names: str) -> list:
    return [F.round(n, 9).alias(n) for n in names]


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.issuer_days(filings(spark, sf_dir))


def issuer_day_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(spark, sf_dir).select(F.col("day").cast("string").alias("day"), "cik", *nine("forecast", "abnormal_return"), "filings", F.col("rose").cast("long").alias("rose"))


def daily_ic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.daily_ic(scores(spark, sf_dir)).select(F.col("day").cast("string").alias("day"), "n", *nine("ic"))


def ic_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.ic_summary(metrics.daily_ic(scores(spark, sf_dir))).select("days", *nine("mean_ic", "error", "t"), "significant")


def ic_newey_west(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.ic_summary(metrics.daily_ic(scores(spark, sf_dir)), lags=5).select("days", *nine("mean_ic", "error", "t"), "significant")


def brier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.brier(judged(spark, sf_dir), ["lang"]).select("lang", *nine("brier"), "n")


def brier_skill_realised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.brier_skill(judged(spark, sf_dir)).select(*nine("skill"), "n")


def brier_skill_const(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.brier_skill(judged(spark, sf_dir), 0.6).select(*nine("skill"), "n")


def brier_skill_per_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = judged(spark, sf_dir).withColumn("rate", F.avg("y").over(Window.partitionBy("lang")))
    return metrics.brier_skill(rows, F.col("rate")).select(*nine("skill"), "n")


def calibration_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.calibration(judged(spark, sf_dir)).select(F.col("band").cast("long").alias("band"), "lower", "upper", *nine("mean_p", "mean_y"), "n")


def weighted_residual(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.weighted_residual(metrics.calibration(judged(spark, sf_dir))).select(*nine("residual"), "above", "below")


_DAILY = f"WITH {FILINGS}, {SCORES}, {ic_sql('scores', 'day')}"
_EDGES = "VALUES " + ", ".join(f"({k}, {lo!r}::DOUBLE, {hi!r}::DOUBLE)" for k, (lo, hi) in enumerate(zip(metrics.CALIBRATION_EDGES, metrics.CALIBRATION_EDGES[1:], strict=False)))
_BANDS = f"""WITH {JUDGED}, edges(band, lower, upper) AS ({_EDGES}), bands AS (
  SELECT band::BIGINT AS band, lower, upper, avg(p) AS mean_p, avg(y) AS mean_y, count(*) AS n
  FROM judged JOIN edges ON p >= lower AND (p < upper OR (band = 9 AND p = upper)) GROUP BY band, lower, upper
)"""
_SUMMARY = "SELECT days, round(mean_ic, 9) AS mean_ic, round(error, 9) AS error, round(mean_ic / error, 9) AS t, abs(mean_ic / error) >= 2 AS significant FROM s"

QUERIES = {f.__name__: f for f in (issuer_day_scores, daily_ic, ic_summary, ic_newey_west, brier, brier_skill_realised, brier_skill_const, brier_skill_per_row, calibration_bins, weighted_residual)}
ORACLE_SQL = {
    "issuer_day_scores": f"WITH {FILINGS}, {SCORES} SELECT CAST(day AS VARCHAR) AS day, cik, round(forecast, 9) AS forecast, round(abnormal_return, 9) AS abnormal_return, filings, rose::BIGINT AS rose FROM scores",
    "daily_ic": f"{_DAILY} SELECT CAST(day AS VARCHAR) AS day, n, round(ic, 9) AS ic FROM daily",
    "ic_summary": f"{_DAILY}, s AS (SELECT count(ic) AS days, avg(ic) AS mean_ic, stddev_samp(ic) / sqrt(count(ic)) AS error FROM daily) {_SUMMARY}",
    "ic_newey_west": f"""{_DAILY}, d AS (SELECT row_number() OVER (ORDER BY day) AS i, ic - avg(ic) OVER () AS d FROM daily WHERE ic IS NOT NULL),
nw AS (SELECT sum(a.d * b.d * (1 - (a.i - b.i) / 6.0) * CASE WHEN a.i = b.i THEN 1 ELSE 2 END) AS s FROM d a JOIN d b ON a.i - b.i BETWEEN 0 AND 5),
s AS (SELECT count(ic) AS days, avg(ic) AS mean_ic, greatest(stddev_samp(ic) / sqrt(count(ic)), sqrt(max(nw.s) / count(ic) / (count(ic) - 1))) AS error FROM daily, nw WHERE ic IS NOT NULL)
{_SUMMARY}""",
    "brier": f"WITH {JUDGED} SELECT lang, round(avg((p - y) * (p - y)), 9) AS brier, count(*) AS n FROM judged GROUP BY lang",
    "brier_skill_realised": f"WITH {JUDGED}, r AS (SELECT p, y, avg(y) OVER () AS rate FROM judged) SELECT round(1 - sum((p - y) * (p - y)) / sum((rate - y) * (rate - y)), 9) AS skill, count(*) AS n FROM r",
    "brier_skill_const": f"WITH {JUDGED} SELECT round(1 - sum((p - y) * (p - y)) / sum((0.6::DOUBLE - y) * (0.6::DOUBLE - y)), 9) AS skill, count(*) AS n FROM judged",
    "brier_skill_per_row": f"WITH {JUDGED}, r AS (SELECT p, y, avg(y) OVER (PARTITION BY lang) AS rate FROM judged) SELECT round(1 - sum((p - y) * (p - y)) / sum((rate - y) * (rate - y)), 9) AS skill, count(*) AS n FROM r",
    "calibration_bins": f"{_BANDS} SELECT band, lower, upper, round(mean_p, 9) AS mean_p, round(mean_y, 9) AS mean_y, n FROM bands",
    "weighted_residual": f"{_BANDS} SELECT round(sum((mean_y - mean_p) * n) / sum(n), 9) AS residual, count(*) FILTER (mean_y > mean_p) AS above, count(*) FILTER (mean_y < mean_p) AS below FROM bands",
}
