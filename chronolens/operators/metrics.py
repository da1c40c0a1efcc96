"""Forecast statistics: rank correlation per day, overlap-robust errors, Brier scores and calibration."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MIN_PER_DAY = 10
SIGNIFICANT_T = 2.0
#: Eleven evenly spaced doubles from 0 to 1; 0.30000000000000004 and its like are part of the definition.
CALIBRATION_EDGES = (0.0, 0.1, 0.2, 0.30000000000000004, 0.4, 0.5, 0.6000000000000001, 0.7000000000000001, 0.8, 0.9, 1.0)


def issuer_days(rows: DataFrame, keys: Sequence[str] = ("day", "cik"), forecast: str = "forecast", outcome: str = "abnormal_return") -> DataFrame:
    """One row a key: mean forecast, mean return, whether the mean return is above zero, and how many rows were merged."""
    grouped = rows.groupBy(*keys).agg(F.avg(forecast).alias(forecast), F.avg(outcome).alias(outcome), F.count(F.lit(1)).alias("filings"))
    return grouped.withColumn("rose", (F.col(outcome) > 0).cast("int"))


def double_rank(of: str, keys: Sequence[str]) -> Column:
    """Twice the average rank, a whole number: sums of it are exact."""
    return 2 * F.rank().over(Window.partitionBy(*keys).orderBy(of)) + F.count(F.lit(1)).over(Window.partitionBy(*keys, of)) - 1


def information_coefficient(rows: DataFrame, keys: Sequence[str], forecast: str = "forecast", outcome: str = "abnormal_return") -> DataFrame:
    """keys, n and ic (Spearman with average ranks; NULL where either side is constant)."""
    ranked = rows.select(*keys, double_rank(forecast, keys).cast("double").alias("x"), double_rank(outcome, keys).cast("double").alias("y"))
    sums = ranked.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.sum("x").alias("sx"), F.sum("y").alias("sy"),
        F.sum(F.col("x") * F.col("x")).alias("sxx"), F.sum(F.col("y") * F.col("y")).alias("syy"), F.sum(F.col("x") * F.col("y")).alias("sxy"),
    )
    vx, vy = F.expr("n * sxx - sx * sx"), F.expr("n * syy - sy * sy")
    ic = F.when((vx > 0) & (vy > 0), F.expr("n * sxy - sx * sy") / F.sqrt(vx * vy))
    return sums.select(*keys, "n", ic.alias("ic"))


def daily_ic(scores: DataFrame, min_per_day: int = MIN_PER_DAY) -> DataFrame:
    return information_coefficient(scores, ["day"]).filter(F.col("n") >= min_per_day)


def t_statistic(mean: Column, error: Column) -> Column:
    """mean / error; without an error infinite in the direction of the mean, NULL if the mean is zero too."""
    return F.when(error > 0, mean / error).when(mean > 0, F.lit(float("inf"))).when(mean < 0, F.lit(float("-inf")))


def newey_west(daily: DataFrame, lags: int, keys: Sequence[str] = ()) -> DataFrame:
    """keys and nw_error: Bartlett weights over the order of defined days, autocovariances over n, scaled by n / (n - 1).

    The lagged products come from one window over the days of a key, so nothing is joined.
    """
    order = Window.partitionBy(*keys).orderBy("day") if keys else Window.partitionBy(F.lit(0)).orderBy("day")
    whole = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    centred = daily.filter(F.col("ic").isNotNull()).withColumn("d", F.col("ic") - F.avg("ic").over(whole))
    products = [
        (F.col("d") * F.lag("d", k, 0.0).over(order) * F.lit((1 if k == 0 else 2) * (1 - k / (lags + 1)))).alias(f"p{k}") if k else (F.col("d") * F.col("d")).alias("p0")
        for k in range(lags + 1)
    ]
    total = sum((F.col(f"p{k}") for k in range(1, lags + 1)), F.col("p0"))
    sums = centred.select(*keys, "day", *products).groupBy(*keys).agg(F.sum(total).alias("s"), F.count(F.lit(1)).alias("n"))
    return sums.select(*keys, F.when((F.col("n") > 1) & (F.col("s") > 0), F.sqrt(F.col("s") / F.col("n") / (F.col("n") - 1))).otherwise(F.lit(0.0)).alias("nw_error"))


def ic_summary(daily: DataFrame, lags: int = 0, keys: Sequence[str] = ()) -> DataFrame:
    """keys, days, mean_ic, error, t, significant. Fewer than two defined days: NULL statistics, counts kept.

    The error is the larger of the independent one and, with lags, the overlap-robust one.
    """
    base = daily.groupBy(*keys).agg(
        F.count("ic").alias("days"), F.avg("ic").alias("mean_ic"), (F.stddev_samp("ic") / F.sqrt(F.count("ic").cast("double"))).alias("error")
    )
    if lags:
        robust = newey_west(daily, lags, keys)
        base = base.join(robust, list(keys), "left") if keys else base.crossJoin(F.broadcast(robust))  # one row each
        base = base.withColumn("error", F.greatest("error", "nw_error")).drop("nw_error")
    enough = F.col("days") >= 2
    base = base.withColumns({"mean_ic": F.when(enough, F.col("mean_ic")), "error": F.when(enough, F.col("error"))})
    base = base.withColumn("t", t_statistic(F.col("mean_ic"), F.col("error")))
    return base.withColumn("significant", F.coalesce(F.abs("t") >= SIGNIFICANT_T, F.lit(False)))


def brier(rows: DataFrame, keys: Sequence[str] = (), p: str = "p", y: str = "y") -> DataFrame:
    return rows.groupBy(*keys).agg(F.avg(F.pow(F.col(p) - F.col(y), 2)).alias("brier"), F.count(F.lit(1)).alias("n"))


def brier_skill(rows: DataFrame, reference: Column | float | None = None, p: str = "p", y: str = "y") -> DataFrame:
    """1 - score / reference score; reference: a constant, a column (one rate a row), or the realised mean. NULL if that scores 0."""
    square = F.pow(F.col(p) - F.col(y), 2)
    if reference is None:
        sums = rows.agg(F.sum(square).alias("own"), F.avg(y).alias("rate"), F.count(F.lit(1)).alias("n"))
        other = F.expr("n * rate * (1 - rate)")
    else:
        rate = reference if isinstance(reference, Column) else F.lit(float(reference))
        sums = rows.agg(F.sum(square).alias("own"), F.sum(F.pow(rate - F.col(y), 2)).alias("other"), F.count(F.lit(1)).alias("n"))
        other = F.col("other")
    return sums.select((1 - F.col("own") / F.nullif(other, F.lit(0.0))).alias("skill"), "n")


def calibration(rows: DataFrame, edges: Sequence[float] = CALIBRATION_EDGES, p: str = "p", y: str = "y") -> DataFrame:
    """band, lower, upper, mean_p, mean_y, n of the bands [lower, upper) that hold rows; the last band is closed."""
    last = len(edges) - 2
    band = F.lit(last)
    for k in range(last - 1, -1, -1):
        band = F.when(F.col(p) < F.lit(edges[k + 1]), F.lit(k)).otherwise(band)
    grouped = rows.filter(F.col(p).between(edges[0], edges[-1])).groupBy(band.alias("band")).agg(
        F.avg(p).alias("mean_p"), F.avg(y).alias("mean_y"), F.count(F.lit(1)).alias("n")
    )
    at = F.array(*[F.lit(e) for e in edges])
    return grouped.select("band", F.get(at, F.col("band")).alias("lower"), F.get(at, F.col("band") + 1).alias("upper"), "mean_p", "mean_y", "n")


def weighted_residual(bands: DataFrame) -> DataFrame:
    """Count-weighted mean of realised minus forecast over calibration bands, with the bands above and below."""
    gap = F.col("mean_y") - F.col("mean_p")
    return bands.agg(
        (F.sum(gap * F.col("n")) / F.sum("n")).alias("residual"), F.count_if(gap > 0).alias("above"), F.count_if(gap < 0).alias("below")
    )
