"""Walk-forward fit: blocks of scored days, training sets that end before each block, weighted logistic regression."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .features import FEATURES

INITIAL_FRACTION = 0.3
BATCH_ROWS = 2048
REFIT_EVERY = 10


class DegenerateTrainingSetError(ValueError):
    """A training set with one outcome only."""


class InsufficientObservationsError(ValueError):
    """Too few days to leave scored ones after the initial window."""


def days_needed(fraction: float) -> int:
    """Fewest populated days that leave two scored ones."""
    n = 2
    while n - math.ceil(fraction * n) < 2:
        n += 1
    return n


def walk_blocks(days: DataFrame, fraction: float = INITIAL_FRACTION, refit_every: int = REFIT_EVERY) -> DataFrame:
    """day, position, block (NULL in the initial window), block_start. One row a day, so one partition may order it."""
    order = Window.partitionBy(F.lit(0)).orderBy("day")
    placed = days.select("day").distinct().withColumns({"position": F.row_number().over(order), "n": F.count(F.lit(1)).over(Window.partitionBy(F.lit(0)))})
    initial = F.ceil(F.col("n") * F.lit(fraction))
    block = F.when(F.col("position") > initial, F.floor((F.col("position") - 1 - initial) / refit_every))
    placed = placed.select("day", "position", block.cast("long").alias("block"))
    return placed.withColumn("block_start", F.when(F.col("block").isNotNull(), F.min("day").over(Window.partitionBy("block"))))


def training_rows(events: DataFrame, blocks: DataFrame) -> DataFrame:
    """block and every event filed, and whose outcome closed, before the block's first day; weight 1 / rows of its issuer-day there."""
    folds = blocks.filter("block IS NOT NULL").select("block", "block_start").distinct()
    rows = events.join(F.broadcast(folds), (F.col("day") < F.col("block_start")) & (F.col("exit_session") < F.col("block_start")))  # tens of folds
    return rows.withColumn("weight", 1.0 / F.count(F.lit(1)).over(Window.partitionBy("block", "day", "cik")))


def first_blocks(events: DataFrame, blocks: DataFrame) -> DataFrame:
    """Every event that enters a fold, once, with first: the earliest block whose start lies after its day and its exit."""
    starts = blocks.filter("block IS NOT NULL").select("block", "block_start").distinct()
    # One row a block; the array holds the starts in order, so a block is its place.
    listed = starts.agg(F.array_sort(F.collect_list(F.struct("block", "block_start"))).alias("_starts"))
    after = F.greatest("day", "exit_session")
    return events.join(F.broadcast(listed)).withColumn("first", F.array_min(F.transform(F.filter("_starts", lambda b: b["block_start"] > after), lambda b: b["block"]))).drop("_starts").filter("first IS NOT NULL")


def fold_rows(events: DataFrame, blocks: DataFrame) -> DataFrame:
    """first_blocks() with the weight of each event from each block on.

    An event trains for its first block and all later ones. steps: (block, weight) of the blocks at which its issuer-day
    gains rows; the weight is one over the rows of the issuer-day.
    """
    placed = first_blocks(events, blocks)
    gained = placed.groupBy("day", "cik", "first").agg(F.count(F.lit(1)).alias("n"))
    so_far = Window.partitionBy("day", "cik").orderBy("first").rowsBetween(Window.unboundedPreceding, 0)
    steps = (
        gained.withColumn("n", F.sum("n").over(so_far)).groupBy(F.col("day").alias("_day"), F.col("cik").alias("_cik"))
        .agg(F.array_sort(F.collect_list(F.struct(F.col("first").alias("block"), (1.0 / F.col("n")).alias("weight")))).alias("steps"))
    )
    joined = placed.join(steps, (F.col("day") == F.col("_day")) & F.col("cik").eqNullSafe(F.col("_cik"))).drop("_day", "_cik")
    return joined.withColumn("steps", F.filter("steps", lambda s: s["block"] >= F.col("first")))


def fold_days(rows: DataFrame, blocks: DataFrame) -> DataFrame:
    """block, base_rate, train_events, train_issuer_days: how often training issuer-days rose.

    An issuer-day changes only at the blocks where it gains rows; the changes are summed by block and then added up.
    """
    gained = rows.groupBy("day", "cik", "first").agg(F.sum("abnormal_return").alias("gain"), F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("day", "cik").orderBy("first")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    rose = (F.sum("gain").over(so_far) > 0).cast("long")
    steps = gained.select("day", "cik", "first", "n", rose.alias("rose"))
    before = F.lag("rose").over(order)
    changes = steps.select("first", "n", (F.col("rose") - F.coalesce(before, F.lit(0))).alias("rose"), F.when(before.isNull(), 1).otherwise(0).alias("fresh"))
    by_block = changes.groupBy(F.col("first").alias("block")).agg(*[F.sum(c).alias(c) for c in ("n", "rose", "fresh")])
    listed = blocks.filter("block IS NOT NULL").select("block").distinct().join(by_block, "block", "left").fillna(0)
    up_to = Window.partitionBy(F.lit(0)).orderBy("block").rowsBetween(Window.unboundedPreceding, 0)  # one row a block
    total = {c: F.sum(c).over(up_to) for c in ("n", "rose", "fresh")}
    return listed.select("block", (total["rose"] / total["fresh"]).alias("base_rate"), total["n"].alias("train_events"), total["fresh"].alias("train_issuer_days")).filter("train_issuer_days > 0")


def fold_sizes(rows: DataFrame, blocks: DataFrame) -> DataFrame:
    """block, day, rows: how many events of each day a block trains on."""
    counted = rows.groupBy("day", "first").agg(F.count(F.lit(1)).alias("n"))
    names = blocks.filter("block IS NOT NULL").select("block").distinct()
    return counted.join(F.broadcast(names), F.col("first") <= F.col("block")).groupBy("block", "day").agg(F.sum("n").alias("rows"))


@dataclass(frozen=True)
class Baseline:
    """Standardisation and weights of one block, in feature order."""

    means: tuple[float, ...]
    scales: tuple[float, ...]
    weights: tuple[float, ...]
    intercept: float


def _parameters(spark: SparkSession, rows: dict[int, list[float]], prefix: str) -> DataFrame:
    """One row a block, broadcast: tens of them."""
    width = len(next(iter(rows.values())))
    schema = "block long, " + ", ".join(f"{prefix}{k} double" for k in range(width))
    return F.broadcast(spark.createDataFrame([(b, *map(float, v)) for b, v in sorted(rows.items())], schema))


def _weights(steps: pa.ListArray, blocks: int) -> np.ndarray:
    """Weight of each row in each block, from its steps."""
    n = len(steps)
    flat = steps.flatten()
    at, weight = flat.field("block").to_numpy(zero_copy_only=False), flat.field("weight").to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(n), np.diff(steps.offsets.to_numpy()))
    until = np.append(at[1:], blocks)
    until[np.append(row[1:] != row[:-1], True)] = blocks
    size = until - at
    out = np.zeros(n * blocks)
    out[np.arange(int(size.sum())) + np.repeat(row * blocks + at - (np.cumsum(size) - size), size)] = np.repeat(weight, size)
    return out.reshape(n, blocks)


def _block_sums(rows: DataFrame, blocks: int, width: int, part: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """part(features, outcomes, weights), an array of blocks by width, summed over all rows: one row a block leaves each task."""
    names = [f"v{k}" for k in range(width)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((blocks, width))
        for batch in batches:
            for lo in range(0, batch.num_rows, BATCH_ROWS):
                some = batch.slice(lo, BATCH_ROWS)
                x = np.stack([c.to_numpy(zero_copy_only=False) for c in some.columns[2:]], axis=1)
                steps = some.column("steps")
                total += part(x, some.column("y").to_numpy(zero_copy_only=False), _weights(pa.ListArray.from_arrays(pc.subtract(steps.offsets, steps.offsets[0]), steps.flatten()), blocks))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(blocks)), *map(pa.array, total.T)], ["block", *names])

    sums = rows.mapInArrow(run, "block long, " + ", ".join(f"{n} double" for n in names)).groupBy("block").agg(*[F.sum(n).alias(n) for n in names])
    out = np.zeros((blocks, width))
    for r in sums.collect():
        out[r["block"]] = [r[n] for n in names]
    return out


def fit_folds(rows: DataFrame, blocks: int, features: tuple[str, ...] = FEATURES, tolerance: float = 1e-10, max_iter: int = 50) -> dict[int, Baseline]:
    """Weighted standardisation (population variance, a constant scaled by 1) and L2 logistic regression with C = 1, every block at once.

    rows hold each event once (fold_rows). Newton's method: each step is one pass over the events that gathers gradient
    and curvature of all blocks, on features standardised over all events; each block's own standardisation is a linear map
    of these sums. So neither the rows nor the jobs follow the number of blocks.
    """
    d = len(features)
    overall = rows.agg(*[F.avg(f).alias(f"m{k}") for k, f in enumerate(features)], *[F.stddev_pop(f).alias(f"s{k}") for k, f in enumerate(features)], F.count(F.lit(1)).alias("n")).first()
    if not overall["n"]:
        raise DegenerateTrainingSetError("a training set holds no event")
    centre, unit = (np.array([overall[f"{c}{k}"] for k in range(d)], float) for c in "ms")
    unit[unit <= 1e-12] = 1.0
    scaled = [((F.col(f) - F.lit(float(centre[k]))) / F.lit(float(unit[k]))).cast("double").alias(f"x{k}") for k, f in enumerate(features)]
    flat = rows.select("steps", F.col("outcome").cast("double").alias("y"), *scaled).persist()
    try:
        first = _block_sums(flat, blocks, d + 3, lambda x, y, w: np.column_stack([w.T @ np.column_stack([np.ones(len(x)), x]), (w > 0).T @ y, (w > 0).sum(axis=0)]))
        weight, ones, count = first[:, 0], first[:, d + 1], first[:, d + 2]
        used = np.flatnonzero(count)
        if not len(used) or (ones[used] == 0).any() or (ones[used] == count[used]).any():
            raise DegenerateTrainingSetError("a training set holds one outcome only")
        means = first[:, 1 : d + 1] / np.maximum(weight, 1e-300)[:, None]
        spread = _block_sums(flat, blocks, d, lambda x, y, w: np.stack([(w * (x[:, k, None] - means[None, :, k]) ** 2).sum(axis=0) for k in range(d)], axis=1))
        scales = np.sqrt(spread / np.maximum(weight, 1e-300)[:, None])
        scales = np.where(scales * unit > 1e-12, scales, 1.0 / unit)
        pairs = [(i, j) for i in range(d + 1) for j in range(i, d + 1)]
        ridge = np.diag([1.0] * d + [0.0])
        beta, active = np.zeros((blocks, d + 1)), set(used.tolist())
        for _ in range(max_iter):
            slope = beta[:, :d] / scales
            level = beta[:, d] - (slope * means).sum(axis=1)

            def part(x: np.ndarray, y: np.ndarray, w: np.ndarray, slope: np.ndarray = slope, level: np.ndarray = level) -> np.ndarray:
                p = 1.0 / (1.0 + np.exp(-(x @ slope.T + level)))
                one = np.column_stack([x, np.ones(len(x))])
                return np.column_stack([(w * (p - y[:, None])).T @ one, (w * p * (1.0 - p)).T @ np.stack([one[:, i] * one[:, j] for i, j in pairs], axis=1)])

            sums = _block_sums(flat, blocks, d + 1 + len(pairs), part)
            for b in sorted(active):
                own = np.eye(d + 1)
                own[:d, :d] = np.diag(1.0 / scales[b])
                own[:d, d] = -means[b] / scales[b]
                bend = np.zeros((d + 1, d + 1))
                for (i, j), v in zip(pairs, sums[b, d + 1 :], strict=True):
                    bend[i, j] = bend[j, i] = v
                step = np.linalg.solve(own @ bend @ own.T + ridge, own @ sums[b, : d + 1] + ridge @ beta[b])
                step *= min(1.0, 5.0 / max(1e-12, float(np.abs(step).max())))
                beta[b] -= step
                if np.abs(step).max() < tolerance:
                    active.discard(b)
            if not active:
                break
    finally:
        flat.unpersist()
    return {b: Baseline(tuple(map(float, centre + unit * means[b])), tuple(map(float, unit * scales[b])), tuple(map(float, beta[b, :d])), float(beta[b, d])) for b in used.tolist()}


def fit(training: DataFrame, features: tuple[str, ...] = FEATURES) -> Baseline:
    """One training set with the weights of its rows."""
    steps = F.array(F.struct(F.lit(0).cast("long").alias("block"), F.col("weight").cast("double").alias("weight")))
    return fit_folds(training.withColumn("steps", steps), 1, features)[0]


def forecast(models: dict[int, Baseline], rows: DataFrame, features: tuple[str, ...] = FEATURES) -> DataFrame:
    """rows (with block) and forecast, the chance that the return is above zero."""
    flat = {b: [x / s for x, s in zip(m.weights, m.scales, strict=True)] + [m.intercept - sum(x * a / s for x, a, s in zip(m.weights, m.means, m.scales, strict=True))] for b, m in models.items()}
    joined = rows.join(_parameters(rows.sparkSession, flat, "_b"), "block")
    score = reduce(lambda a, b: a + b, [F.col(f) * F.col(f"_b{k}") for k, f in enumerate(features)], F.col(f"_b{len(features)}"))
    return joined.withColumn("forecast", 1 / (1 + F.exp(-score))).drop(*[f"_b{k}" for k in range(len(features) + 1)])


def coefficients(model: Baseline, features: tuple[str, ...] = FEATURES) -> dict[str, float]:
    """Standardised weights by name."""
    return dict(zip(features, model.weights, strict=True))


def forecast_walk_forward(events: DataFrame, fraction: float = INITIAL_FRACTION, refit_every: int = REFIT_EVERY) -> tuple[DataFrame, list[dict]]:
    """Scored events with forecast, block and base_rate, and one entry a fold with its weights."""
    days = walk_blocks(events, fraction, refit_every)
    folds = days.filter("block IS NOT NULL").groupBy("block", "block_start").count().orderBy("block").collect()
    if sum(f["count"] for f in folds) < 2:
        raise InsufficientObservationsError("the walk leaves fewer than two scored days")
    training = fold_rows(events, days).persist()
    rates = {r["block"]: r for r in fold_days(training, days).collect()}
    models = fit_folds(training, len(folds))
    training.unpersist()
    if lacking := [f["block"] for f in folds if f["block"] not in models]:
        raise DegenerateTrainingSetError(f"blocks {lacking} train on no event")
    scored = events.join(F.broadcast(days.filter("block IS NOT NULL").select("day", "block")), "day")  # one row a day
    scored = forecast(models, scored).join(_parameters(events.sparkSession, {b: [r["base_rate"]] for b, r in rates.items()}, "_r"), "block").withColumnRenamed("_r0", "base_rate")
    reports = [{"block": f["block"], "start": f["block_start"], **rates[f["block"]].asDict(), "coefficients": coefficients(models[f["block"]])} for f in folds]
    return scored, reports
