"""Trading calendar: weekdays without the scheduled holidays, indexed densely."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Scheduled market holidays of the covered years.
HOLIDAYS = (
    "2026-01-01", "2026-01-19", "2026-02-16", "2026-04-03", "2026-05-25", "2026-06-19", "2026-07-03", "2026-09-07", "2026-11-26", "2026-12-25",
    "2027-01-01", "2027-01-18", "2027-02-15", "2027-03-26", "2027-05-31", "2027-06-18", "2027-07-05", "2027-09-06", "2027-11-25", "2027-12-24",
)
COVERED_YEARS = (2026, 2027)


class UncoveredCalendarError(ValueError):
    """A date in a year whose holidays are not known."""


class MissingDaysError(ValueError):
    """Trading days of a range that were never built."""


def is_trading_day(day: dt.date, holidays: Iterable[str] = HOLIDAYS, years: Iterable[int] = COVERED_YEARS) -> bool:
    if day.year not in set(years):
        raise UncoveredCalendarError(f"{day} is in a year without a holiday table")
    return day.weekday() < 5 and day.isoformat() not in set(holidays)


def trading_calendar(spark: SparkSession, start: str, end: str, holidays: Iterable[str] = HOLIDAYS, years: Iterable[int] = COVERED_YEARS) -> DataFrame:
    """day, idx: every day from start to end with the number of sessions up to and including it, and whether it is one."""
    if outside := {int(start[:4]), int(end[:4])} - set(years):
        raise UncoveredCalendarError(f"years {sorted(outside)} have no holiday table")
    days = spark.range(1).select(F.explode(F.sequence(F.to_date(F.lit(start)), F.to_date(F.lit(end)))).alias("day"))
    closed = F.col("day").cast("string").isin(*holidays) if (holidays := tuple(holidays)) else F.lit(False)
    days = days.withColumn("trading", (F.weekday("day") < 5) & ~closed)
    # one row a calendar day: small by nature, so one partition may order it
    return days.withColumn("idx", F.sum(F.col("trading").cast("long")).over(Window.partitionBy(F.lit(0)).orderBy("day")))


def sessions_after(rows: DataFrame, calendar: DataFrame, n: int, day: str = "day", out: str = "session") -> DataFrame:
    """rows with the nth trading day strictly after their day (NULL past the calendar's end)."""
    place = calendar.select(F.col("day").alias("_d"), (F.col("idx") + n).alias("_i"))
    sessions = calendar.filter("trading").select(F.col("idx").alias("_j"), F.col("day").alias(out))
    placed = rows.join(F.broadcast(place), F.col(day) == F.col("_d"), "left")  # a calendar has a few thousand rows at most
    return placed.join(F.broadcast(sessions), F.col("_i") == F.col("_j"), "left").drop("_d", "_i", "_j")


def window_close(rows: DataFrame, calendar: DataFrame, horizon: int, day: str = "day") -> DataFrame:
    """One session to the entry and `horizon` more."""
    return sessions_after(rows, calendar, horizon + 1, day, "closes_on")


def sampled_days(calendar: DataFrame, every: int) -> DataFrame:
    """Every nth trading day, the calendar's first included."""
    first = F.min("idx").over(Window.partitionBy("trading"))
    return calendar.filter("trading").withColumn("_k", (F.col("idx") - first) % every).filter("_k = 0").select("day")


def missing_days(calendar: DataFrame, built: DataFrame) -> DataFrame:
    """Trading days without a built partition."""
    return calendar.filter("trading").select("day").join(built.select("day").distinct(), "day", "left_anti")


def require_built(calendar: DataFrame, built: DataFrame, shown: int = 5) -> None:
    """Raise, naming the first of them, if a trading day has no built partition."""
    gaps = missing_days(calendar, built)
    first = [r["day"].isoformat() for r in gaps.orderBy("day").limit(shown).collect()]
    if first:
        raise MissingDaysError(f"{gaps.count()} trading days have no packets, the first: {', '.join(first)}")
