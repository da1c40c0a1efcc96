"""Leakage-free event features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text

# The feature order of the model, and the words of a title that name a role.
FEATURES = (
    "is_purchase", "log_value_usd", "fraction_of_holding", "reports_holding", "is_officer", "is_director", "is_ten_percent_owner",
    "insiders_trading_same_issuer",
)
OFFICER = ("officer", "ceo", "cfo", "coo", "president", "chief", "vp", "vice president")
DIRECTOR = ("director",)
TEN_PERCENT = ("10%", "ten percent", "10 percent")


class UnsupportedDomainError(NotImplementedError):
    """Rows without the fields the features are made of."""


def _names_any(title: Column, words: tuple[str, ...]) -> Column:
    found = title.contains(words[0])
    for w in words[1:]:
        found = found | title.contains(w)
    return F.coalesce(found, F.lit(False)).cast("double")


def role_flags(position: Column) -> dict[str, Column]:
    title = F.lower(text.stripped(position))
    return {"is_officer": _names_any(title, OFFICER), "is_director": _names_any(title, DIRECTOR), "is_ten_percent_owner": _names_any(title, TEN_PERCENT)}


def holding_fraction(shares: Column, remaining: Column, purchase: Column) -> tuple[Column, Column]:
    """Traded share of the holding before the trade, and whether it is known.

    A sale adds the shares back, a purchase takes them off; buying from nothing is 1, buying more than is held now is
    unknown.
    """
    s, r = shares.cast("double"), remaining.cast("double")
    unknown = s.isNull() | r.isNull() | (s <= 0) | (purchase & (r < s))
    before = F.when(purchase, r - s).otherwise(r + s)
    share = F.when(unknown, 0.0).when(before == 0, 1.0).otherwise(F.least(s / F.nullif(before, F.lit(0.0)), F.lit(1.0)))
    return share, F.when(unknown, 0.0).otherwise(1.0)


def insiders_so_far(events: DataFrame) -> Column:
    """Distinct insiders that filed for the issuer on the day up to and with the event's own instant: a running count of first filings."""
    if "insider_name" not in events.columns:
        raise UnsupportedDomainError(f"no features are defined for rows with {sorted(events.columns)}")
    issuer_day = Window.partitionBy("day", "cik")
    first = F.row_number().over(Window.partitionBy("day", "cik", "insider_name").orderBy("as_of")) == 1
    news = first & F.col("insider_name").isNotNull()
    return F.sum(news.cast("double")).over(issuer_day.orderBy("as_of").rangeBetween(Window.unboundedPreceding, Window.currentRow))


def with_features(events: DataFrame) -> DataFrame:
    """events with the eight features; compute before joining outcomes, so that none depends on what resolved."""
    purchase = F.upper(text.stripped(F.col("transaction_code"))) == "P"
    fraction, known = holding_fraction(F.col("shares"), F.col("remaining_shares"), purchase)
    return events.withColumns({
        "is_purchase": purchase.cast("double"),
        "log_value_usd": F.coalesce(F.log1p(F.col("value_usd").cast("double")), F.lit(0.0)),
        "fraction_of_holding": fraction, "reports_holding": known, **role_flags(F.col("position")),
        "insiders_trading_same_issuer": insiders_so_far(events),
    })


def label_coverage(events: DataFrame, labels: DataFrame, exclusions: DataFrame, key: str = "accession_no") -> tuple[DataFrame, DataFrame]:
    """Labels that name no event, and events with neither label nor exclusion; both must be empty."""
    e, own = events.select(key).distinct(), labels.select(key).distinct()
    return own.join(e, key, "left_anti"), e.join(own, key, "left_anti").join(exclusions.select(key).distinct(), key, "left_anti")


def with_outcomes(featured: DataFrame, labels: DataFrame, key: str = "accession_no", position: str = "position") -> DataFrame:
    """Inner join to the first label of a filing in stored order; outcome is whether its return is above zero."""
    first = labels.groupBy(key).agg(F.min_by(F.struct("abnormal_return", "exit_session"), position).alias("_l"))
    return featured.join(first, key).select(*featured.columns, "_l.*").withColumn("outcome", (F.col("abnormal_return") > 0).cast("int"))
