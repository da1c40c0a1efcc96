"""Rank correlation within groups: by size, by insider type; with accounts that add up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .metrics import MIN_PER_DAY, ic_summary, information_coefficient

MIXED, UNCLASSIFIED = "mixed", "unclassified"
LOOKBACK_YEARS = 3


def issuer_sizes(sizes: DataFrame) -> DataFrame:
    """day, cik, size: the largest of the issuer's figures of the day."""
    return sizes.groupBy("day", "cik").agg(F.max("size").alias("size"))


def size_buckets(sizes: DataFrame, buckets: int = 3) -> DataFrame:
    """Terciles of the day's sized issuers, ties by issuer number; issuers without a size are not ranked."""
    order = Window.partitionBy("day").orderBy("size", "cik")
    return sizes.filter("size IS NOT NULL").withColumn("bucket", (F.ntile(buckets).over(order) - 1).cast("long"))


def ic_within_groups(scores: DataFrame, group: str, lags: int = 0, min_per_day: int = MIN_PER_DAY) -> tuple[DataFrame, DataFrame]:
    """Per group: days, mean_ic, error, t, issuer_days; and one row of accounts.

    total = sum of issuer_days + dropped (in group-days below the minimum) + ungrouped (no group).
    """
    counted = scores.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("day", group)))
    grouped, enough = F.col(group).isNotNull(), F.col("_n") >= min_per_day
    used = counted.filter(grouped & enough)
    daily = information_coefficient(used, [group, "day"])
    sizes = used.groupBy(group).agg(F.count(F.lit(1)).alias("issuer_days"))
    table = ic_summary(daily, lags, [group]).join(sizes, group)
    accounts = counted.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(grouped & enough).alias("in_rows"), F.count_if(grouped & ~enough).alias("dropped"), F.count_if(~grouped).alias("ungrouped")
    )
    return table, accounts


def contributing_medians(scores: DataFrame, group: str = "bucket", value: str = "size", min_per_day: int = MIN_PER_DAY) -> DataFrame:
    """Median of value over the members of group-days that count."""
    counted = scores.filter(F.col(group).isNotNull()).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("day", group)))
    return counted.filter(F.col("_n") >= min_per_day).groupBy(group).agg(F.median(value).alias(f"median_{value}"))


def history_trades(submissions: DataFrame, transactions: DataFrame, owners: DataFrame) -> tuple[DataFrame, DataFrame]:
    """owner, issuer, year, month, filed of open-market trades in insider filings, and how many rows were skipped and why.

    submissions: accession_no, form, filed, issuer; transactions: accession_no, code, traded; owners: accession_no,
    owner. Dates and numbers that did not parse are NULL. Unparseable are submissions of the wanted forms, trades of
    usable submissions, and owners of usable trades.
    """
    wanted = submissions.filter(F.col("form").isin("4", "4/A"))
    whole = F.col("filed").isNotNull() & F.col("issuer").isNotNull()
    trades = wanted.filter(whole).join(transactions.filter(F.col("code").isin("P", "S")), "accession_no")
    late = F.col("traded") > F.col("filed")
    usable = trades.filter(F.col("traded").isNotNull() & ~late)
    named = owners.join(usable.select("accession_no"), "accession_no", "left_semi")
    none = F.lit(0).cast("long")
    counts = (
        wanted.agg(F.count_if(~whole).alias("unparseable"), none.alias("future_dated"))
        .unionByName(trades.agg(F.count_if(F.col("traded").isNull()).alias("unparseable"), F.coalesce(F.count_if(late), none).alias("future_dated")))
        .unionByName(named.agg(F.count_if(F.col("owner").isNull()).alias("unparseable"), none.alias("future_dated")))
    )
    skipped = counts.agg(F.sum("unparseable").alias("unparseable"), F.sum("future_dated").alias("future_dated"))
    kept = usable.join(owners.filter("owner IS NOT NULL"), "accession_no")
    return kept.select("owner", "issuer", F.year("traded").cast("long").alias("year"), F.month("traded").cast("long").alias("month"), "filed").distinct(), skipped


def pair_classes(pairs: DataFrame, history: DataFrame, accepted: str = "accepted") -> DataFrame:
    """pairs (owner, issuer, accepted as Eastern date) with class: routine, opportunistic or unclassified.

    Only trades filed strictly before count, of the three calendar years before. All three years must have one; a month
    that all three share makes the pair routine. History is reduced to one row a pair first, at most twelve entries a
    year, so events are joined without fan-out.
    """
    months = history.groupBy("owner", "issuer", "year", "month").agg(F.min("filed").alias("filed"))  # the earliest filing decides
    known = months.groupBy("owner", "issuer").agg(F.collect_list(F.struct("year", "month", "filed")).alias("_h"))
    recent = F.filter("_h", lambda x: (x["filed"] < F.col(accepted)) & x["year"].between(F.year(accepted) - LOOKBACK_YEARS, F.year(accepted) - 1))
    covered = F.size(F.array_distinct(F.transform("_recent", lambda x: x["year"])))
    shared = F.exists(F.sequence(F.lit(1), F.lit(12)), lambda m: F.size(F.filter("_recent", lambda x: x["month"] == m)) == LOOKBACK_YEARS)
    kind = F.when(F.col("_recent").isNull() | (covered < LOOKBACK_YEARS), UNCLASSIFIED).when(shared, "routine").otherwise("opportunistic")
    return pairs.join(known, ["owner", "issuer"], "left").withColumn("_recent", recent).withColumn("class", kind).drop("_h", "_recent")


def agreed(classes: Column, mixed: str = UNCLASSIFIED) -> Column:
    """The one class of a set; `mixed` for several or none."""
    return F.when(F.size(classes) == 1, F.get(classes, F.lit(0))).otherwise(mixed)


def event_classes(owner_classes: DataFrame, key: str = "accession_no") -> DataFrame:
    """All owners agree, else unclassified."""
    return owner_classes.groupBy(key).agg(agreed(F.collect_set("class")).alias("class"))


def issuer_day_classes(events: DataFrame) -> DataFrame:
    """day, cik, class over events with a class; unclassified ones do not speak, differing ones are mixed."""
    spoken = F.collect_set(F.when(F.col("class") != UNCLASSIFIED, F.col("class")))
    return events.groupBy("day", "cik").agg(F.when(F.size(spoken) == 0, UNCLASSIFIED).otherwise(agreed(spoken, MIXED)).alias("class"))


def ic_by_type(scores: DataFrame, classes: DataFrame, lags: int = 0, min_per_day: int = MIN_PER_DAY) -> tuple[DataFrame, DataFrame]:
    """Rows for routine and opportunistic issuer-days; accounts also tell mixed from unclassified."""
    joined = scores.join(classes, ["day", "cik"], "left")
    kind = F.when(F.col("class").isin("routine", "opportunistic"), F.col("class"))
    table, accounts = ic_within_groups(joined.withColumn("kind", kind), "kind", lags, min_per_day)
    mixed = joined.agg(F.count_if(F.col("class") == MIXED).alias("mixed"))
    accounts = accounts.crossJoin(mixed).withColumn("unclassified", F.col("ungrouped") - F.col("mixed"))  # one row each
    return table, accounts


def compare_arms(base: DataFrame, other: DataFrame, first: str, last: str, min_per_day: int = MIN_PER_DAY) -> tuple[DataFrame, DataFrame]:
    """Daily rank correlations of two forecasts on the issuer-days both cover, and one row of accounts.

    base: day, cik, accession_no, forecast, abnormal_return; other: accession_no, forecast. An issuer-day counts only if
    the other arm forecast every one of its events. compared + unranked + dropped = issuer-days of the window.
    """
    rows = base.filter(F.col("day").between(F.to_date(F.lit(first)), F.to_date(F.lit(last)))).join(other.select("accession_no", F.col("forecast").alias("other")), "accession_no", "left")
    days = rows.groupBy("day", "cik").agg(F.avg("forecast").alias("forecast"), F.avg("other").alias("other"), F.avg("abnormal_return").alias("abnormal_return"), F.bool_and(F.col("other").isNotNull()).alias("whole"))
    days = days.withColumn("n", F.count_if("whole").over(Window.partitionBy("day")))
    used = days.filter(F.col("whole") & (F.col("n") >= min_per_day))
    one = information_coefficient(used, ["day"]).select("day", F.col("ic").alias("base_ic"), "n")
    two = information_coefficient(used, ["day"], "other").select("day", F.col("ic").alias("other_ic"))
    both = one.join(two, "day").filter("base_ic IS NOT NULL AND other_ic IS NOT NULL").withColumn("difference", F.col("base_ic") - F.col("other_ic"))
    accounts = days.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(~F.col("whole")).alias("dropped"), F.count_if(F.col("whole") & (F.col("n") < min_per_day)).alias("unranked"),
        F.count_if(F.col("whole") & (F.col("n") >= min_per_day)).alias("compared"),
    )
    return both, accounts
