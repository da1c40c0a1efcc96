"""Queries over features, label coverage and the walk-forward fit."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import features, metrics, walkforward
from .roles import FILINGS, filings, read


def role_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = features.role_flags(F.col("position"))
    rows = filings(spark, sf_dir).select("position", *[c.alias(n) for n, c in flags.items()])
    return rows.groupBy("position", *flags).agg(F.count(F.lit(1)).alias("n"))


def holding_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    share, known = features.holding_fraction(F.when(F.col("accession_no") % 11 > 0, F.col("shares")), F.col("remaining_shares"), F.col("transaction_code") == "P")
    return filings(spark, sf_dir).select("accession_no", F.round(share, 9).alias("fraction"), known.alias("known"))


def event_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = features.with_features(filings(spark, sf_dir))
    return rows.select("accession_no", *[F.round(f, 9).alias(f) for f in features.FEATURES])


def clustered_insiders(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = filings(spark, sf_dir)
    return rows.select("accession_no", features.insiders_so_far(rows).cast("long").alias("insiders"))


def _labels(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("accession_no"))
    labels = read(spark, sf_dir, "labels").select((F.col("doc_id") + F.when(F.col("doc_id") % 17 == 0, 10_000_000).otherwise(0)).alias("accession_no"))
    return docs, labels, docs.filter("accession_no % 2 = 0")


def stray_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.label_coverage(*_labels(spark, sf_dir))[0]


def label_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.label_coverage(*_labels(spark, sf_dir))[1]


def labelled_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels, _ = _labels(spark, sf_dir)
    return docs.join(labels, "accession_no", "left_semi")


def first_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's first label of two: what its quality says, then the opposite; odd documents have them the other way round."""
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("accession_no"))
    rows = read(spark, sf_dir, "labels").select(F.col("doc_id").alias("accession_no"), (F.col("quality") - 0.5).alias("r"), F.explode(F.array(F.lit(0), F.lit(1))).alias("position"))
    told = F.when((F.col("position") + F.col("accession_no")) % 2 == 0, F.col("r")).otherwise(-F.col("r"))
    labels = rows.select("accession_no", "position", told.alias("abnormal_return"), F.lit("2026-06-09").alias("exit_session"))
    return features.with_outcomes(docs, labels).select("accession_no", F.col("abnormal_return").cast("double").alias("abnormal_return"), "outcome")


def _folds(spark: SparkSession, sf_dir: str, held: Callable[[DataFrame, DataFrame], DataFrame] = walkforward.first_blocks) -> tuple[DataFrame, DataFrame]:
    blocks = walkforward.walk_blocks(filings(spark, sf_dir))
    return held(filings(spark, sf_dir), blocks), blocks


def issuer_day_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and weight of each training set; what an event adds to a block is the change of its weight there."""
    rows, blocks = _folds(spark, sf_dir, walkforward.fold_rows)
    change = F.transform("steps", lambda s, k: F.struct(s["block"].alias("block"), (s["weight"] - F.when(k > 0, F.get(F.col("steps"), k - 1)["weight"]).otherwise(0.0)).alias("w"), F.when(k == 0, 1).otherwise(0).alias("n")))
    added = rows.select(F.explode(change).alias("c")).groupBy("c.block").agg(F.sum("c.n").alias("n"), F.sum("c.w").alias("w"))
    return added.join(F.broadcast(blocks.filter("block IS NOT NULL").select(F.col("block").alias("b")).distinct()), F.col("block") <= F.col("b")).groupBy(F.col("b").alias("block")).agg(F.sum("n").alias("rows"), F.round(F.sum("w"), 6).alias("issuer_days"))


def walk_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = walkforward.walk_blocks(filings(spark, sf_dir))
    return b.select(F.col("day").cast("string").alias("day"), F.col("position").cast("long").alias("position"), "block", F.col("block_start").cast("string").alias("block_start"))


def fold_training_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return walkforward.fold_sizes(*_folds(spark, sf_dir)).withColumn("day", F.col("day").cast("string"))


def base_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return walkforward.fold_days(*_folds(spark, sf_dir)).withColumn("base_rate", F.round("base_rate", 9))


def _model_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.with_features(filings(spark, sf_dir)).withColumn("outcome", (F.col("abnormal_return") > 0).cast("int")).drop("forecast")


def walk_forward_forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored, _ = walkforward.forecast_walk_forward(_model_rows(spark, sf_dir))
    return scored.select("accession_no", "block", F.round("forecast", 6).alias("forecast"), F.round("base_rate", 6).alias("base_rate"))


def coefficients(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, folds = walkforward.forecast_walk_forward(_model_rows(spark, sf_dir))
    return spark.createDataFrame([(f["block"], n, float(w)) for f in folds for n, w in f["coefficients"].items()], "block long, feature string, weight double")


def evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: rank correlation, skills, rates and counts of the walk-forward forecasts."""
    scored, _ = walkforward.forecast_walk_forward(_model_rows(spark, sf_dir))
    rates = scored.groupBy("day").agg(F.first("base_rate").alias("base_rate"))
    days = metrics.issuer_days(scored).join(F.broadcast(rates), "day")
    pooled = days.select(F.col("forecast").alias("p"), F.col("rose").cast("double").alias("y"), "base_rate")
    ic = metrics.ic_summary(metrics.daily_ic(days), lags=5)
    skill = metrics.brier_skill(pooled, F.col("base_rate")).select(F.col("skill").alias("brier_skill"), F.col("n").alias("pooled_issuer_days"))
    hindsight = metrics.brier_skill(pooled).select(F.col("skill").alias("brier_skill_scored_rate"))
    counts = days.agg(F.sum("filings").alias("test_events"), F.avg("base_rate").alias("fitted_base_rate"), F.avg("rose").alias("base_rate"))
    return ic.crossJoin(skill).crossJoin(hindsight).crossJoin(counts)  # one row each


_BLOCKS = """days AS (SELECT day, row_number() OVER (ORDER BY day) AS position, count(*) OVER () AS n FROM (SELECT DISTINCT day FROM filings)),
b0 AS (SELECT day, position, CASE WHEN position > ceil(n * 0.3::DOUBLE) THEN CAST(floor((position - 1 - ceil(n * 0.3::DOUBLE)) / 10) AS BIGINT) END AS block FROM days),
blocks AS (SELECT *, CASE WHEN block IS NOT NULL THEN min(day) OVER (PARTITION BY block) END AS block_start FROM b0),
train AS (SELECT b.block, f.* FROM filings f JOIN (SELECT DISTINCT block, block_start FROM blocks WHERE block IS NOT NULL) b ON f.day < b.block_start AND f.exit_session < b.block_start)"""
_OWN = "own AS (SELECT doc_id + CASE WHEN doc_id % 17 = 0 THEN 10000000 ELSE 0 END AS accession_no FROM labels)"

QUERIES = {
    f.__name__: f
    for f in (
        role_flags, holding_fraction, event_features, clustered_insiders, stray_labels, label_coverage, labelled_only, first_outcomes, issuer_day_weights, walk_blocks, fold_training_set,
        base_rates, walk_forward_forecasts, coefficients, evaluation,
    )
}
_FRACTION = """CASE WHEN s IS NULL OR r IS NULL OR s <= 0 OR (buy AND r < s) THEN 0.0 WHEN (CASE WHEN buy THEN r - s ELSE r + s END) = 0 THEN 1.0
  ELSE least(s / (CASE WHEN buy THEN r - s ELSE r + s END), 1.0) END"""
_KNOWN = "CASE WHEN s IS NULL OR r IS NULL OR s <= 0 OR (buy AND r < s) THEN 0.0 ELSE 1.0 END"
_FLAGS = """CAST(CAST(regexp_matches(lower(position), 'officer|ceo|cfo|coo|president|chief|vp|vice president') AS INTEGER) AS DOUBLE) AS is_officer,
  CAST(CAST(contains(lower(position), 'director') AS INTEGER) AS DOUBLE) AS is_director,
  CAST(CAST(regexp_matches(lower(position), '10%|ten percent|10 percent') AS INTEGER) AS DOUBLE) AS is_ten_percent_owner"""
_CLUSTER = "c AS (SELECT a.accession_no, count(DISTINCT b.insider_name) AS insiders FROM filings a JOIN filings b ON a.day = b.day AND a.cik = b.cik AND b.as_of <= a.as_of GROUP BY 1)"
ORACLE_SQL = {
    "role_flags": f"WITH {FILINGS} SELECT position, {_FLAGS}, count(*) AS n FROM filings GROUP BY ALL",
    "holding_fraction": f"""WITH {FILINGS}, x AS (SELECT accession_no, CASE WHEN accession_no % 11 > 0 THEN shares::DOUBLE END AS s, remaining_shares::DOUBLE AS r, transaction_code = 'P' AS buy FROM filings)
SELECT accession_no, round({_FRACTION}, 9)::DOUBLE AS fraction, ({_KNOWN})::DOUBLE AS known FROM x""",
    "event_features": f"""WITH {FILINGS}, {_CLUSTER}, x AS (SELECT *, shares::DOUBLE AS s, remaining_shares::DOUBLE AS r, transaction_code = 'P' AS buy FROM filings)
SELECT accession_no, CAST(CAST(buy AS INTEGER) AS DOUBLE) AS is_purchase, round(ln(1 + value_usd), 9) AS log_value_usd, round({_FRACTION}, 9)::DOUBLE AS fraction_of_holding, ({_KNOWN})::DOUBLE AS reports_holding,
  {_FLAGS}, insiders::DOUBLE AS insiders_trading_same_issuer FROM x JOIN c USING (accession_no)""",
    "clustered_insiders": f"WITH {FILINGS}, {_CLUSTER} SELECT accession_no, insiders FROM c",
    "stray_labels": f"WITH {_OWN} SELECT DISTINCT accession_no FROM own ANTI JOIN (SELECT doc_id AS accession_no FROM documents) USING (accession_no)",
    "label_coverage": f"WITH {_OWN} SELECT doc_id AS accession_no FROM documents WHERE doc_id NOT IN (SELECT accession_no FROM own) AND doc_id % 2 <> 0",
    "labelled_only": f"WITH {_OWN} SELECT doc_id AS accession_no FROM documents WHERE doc_id IN (SELECT accession_no FROM own)",
    "first_outcomes": """WITH l AS (SELECT doc_id AS accession_no, CASE WHEN doc_id % 2 = 0 THEN quality - 0.5 ELSE 0.5 - quality END::DOUBLE AS abnormal_return FROM labels)
SELECT accession_no, abnormal_return, CAST(abnormal_return > 0 AS INTEGER) AS outcome FROM l SEMI JOIN (SELECT doc_id AS accession_no FROM documents) USING (accession_no)""",
    "issuer_day_weights": f"WITH {FILINGS}, {_BLOCKS} SELECT block, count(*) AS rows, round(count(DISTINCT (day, cik))::DOUBLE, 6) AS issuer_days FROM train GROUP BY block",
    "walk_blocks": f"WITH {FILINGS}, {_BLOCKS} SELECT CAST(day AS VARCHAR) AS day, position, block, CAST(block_start AS VARCHAR) AS block_start FROM blocks",
    "fold_training_set": f"WITH {FILINGS}, {_BLOCKS} SELECT block, CAST(day AS VARCHAR) AS day, count(*) AS rows FROM train GROUP BY ALL",
    "base_rates": f"""WITH {FILINGS}, {_BLOCKS}, d AS (SELECT block, day, cik, avg(abnormal_return) > 0 AS rose, count(*) AS n FROM train GROUP BY ALL)
SELECT block, round(avg(CAST(rose AS INTEGER)), 9) AS base_rate, sum(n)::BIGINT AS train_events, count(*) AS train_issuer_days FROM d GROUP BY block""",
}
