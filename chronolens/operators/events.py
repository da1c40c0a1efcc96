"""From raw filings to screened events: presence, screens, dedupe, owners, tickers, guards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text

OPEN_MARKET = ("P", "S")
DEFAULT_FLOOR = 50_000
PRESENCE = ("Code", "Shares", "Price", "Value", "Remaining Shares")
TRANSACTION_KEY = ("Code", "Shares", "Price", "Value", "Remaining Shares", "Insider", "Date")


class MissingColumnsError(ValueError):
    """A transaction table lacks columns it must have."""


def require_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    if missing := [n for n in names if n not in df.columns]:
        raise MissingColumnsError(f"columns {missing} are missing from {df.columns}")
    return df


def insider_screen(events: DataFrame, floor: float = DEFAULT_FLOOR) -> DataFrame:
    """Open-market trades outside trading plans of at least `floor` (inclusive)."""
    return events.filter(~F.col("is_plan") & F.col("transaction_code").isin(*OPEN_MARKET) & (F.col("value_usd") >= floor))


def present_rows(rows: DataFrame, columns: Sequence[str] = PRESENCE) -> DataFrame:
    """Transaction rows in which any of the columns holds a value."""
    any_value: Column = F.lit(False)
    for name in require_columns(rows, columns).select(*[f"`{c}`" for c in columns]).columns:
        any_value = any_value | ~text.is_blank(F.col(f"`{name}`").cast("string"))
    return rows.filter(any_value)


def dedupe_first(rows: DataFrame, key: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The first row of each key in the given order (joint filers repeat a filing in the index)."""
    own = [c for c in rows.columns if c not in key]
    first = rows.groupBy(*key).agg(F.min(F.struct(*[(F.col(o) if isinstance(o, str) else o).alias(f"_o{i}") for i, o in enumerate(order)], *own)).alias("_r"))
    return first.select(*key, *[F.col(f"_r.{c}").alias(c) for c in own])


def dedupe_transactions(rows: DataFrame, filing: str, key: Sequence[str]) -> DataFrame:
    """Distinct transactions of a filing, compared as text: 5 and 5.0 differ."""
    return rows.select(filing, *[F.col(k).cast("string").alias(k) for k in key]).distinct()


def owner_set(owners: Column) -> Column:
    """Distinct owner numbers in order, from zero-padded text or numbers."""
    return F.array_sort(F.array_distinct(F.transform(owners, lambda x: x.cast("long"))))


def redflag_events(reports: DataFrame) -> DataFrame:
    """Reports with a trigger item; missing text is empty, not a reason to drop."""
    return (
        reports.withColumn("item_codes", text.item_codes(F.col("items"))).filter(F.size("item_codes") > 0)
        .withColumn("item_text", F.coalesce("text", F.lit(""))).drop("items", "text")
    )


def cover_securities(facts: DataFrame) -> DataFrame:
    """accession_no, symbol, title, entity_cik from cover-page facts (concept, value, context_ref, is_dimensioned, entity_identifier, dimensions).

    Symbol and title pair by context, the first title of a context wins; a registrant named by a dimension member takes
    the number stated for that member.
    """
    keys = ["accession_no", "context_ref"]
    member = F.element_at("dimensions", "dei:LegalEntityAxis")

    def of(concept: str) -> DataFrame:
        return facts.filter(F.col("concept") == concept)

    symbols = of("dei:TradingSymbol").select(*keys, F.col("value").alias("symbol"), member.alias("member"), "entity_identifier", "seq")
    titles = dedupe_first(of("dei:Security12bTitle").select(*keys, "seq", F.col("value").alias("title")), keys, ["seq"]).select(*keys, "title")
    ciks = dedupe_first(of("dei:EntityCentralIndexKey").select("accession_no", member.alias("member"), "seq", F.col("value").alias("cik")), ["accession_no", "member"], ["seq"])
    joined = symbols.join(titles, keys, "left").join(
        ciks.select(F.col("accession_no").alias("a2"), F.col("member").alias("m2"), F.col("cik").alias("member_cik")),
        (F.col("accession_no") == F.col("a2")) & F.col("member").eqNullSafe(F.col("m2")), "left",
    )
    return joined.select("accession_no", "symbol", "title", F.coalesce("member_cik", "entity_identifier").try_cast("long").alias("entity_cik"), "seq")


def choose_ticker(securities: DataFrame, filing: str = "accession_no", issuer: str = "cik") -> DataFrame:
    """filing, ticker: the issuer's first common-equity symbol, else its only tradeable one unless titled as something else."""
    own = securities.filter(F.col("entity_cik") == F.col(issuer)).withColumn("s", text.tradeable_symbol(F.col("symbol"))).filter("s IS NOT NULL")
    named = F.coalesce(text.title_class(F.col("title")), F.lit(""))
    common, other = named == "common", named == "other"
    picked = own.groupBy(filing).agg(
        F.min_by("s", F.when(common, F.col("seq"))).alias("first_common"), F.count(F.lit(1)).alias("n"), F.min("s").alias("only"), F.bool_or(other).alias("other")
    )
    alone = F.when((F.col("n") == 1) & ~F.col("other"), F.col("only"))
    return picked.select(filing, F.coalesce("first_common", alone).alias("ticker")).filter("ticker IS NOT NULL")


def with_ticker(events: DataFrame, tickers: DataFrame, filing: str = "accession_no") -> DataFrame:
    """events with ticker and its source where the filing states one."""
    return events.join(tickers, filing, "left").withColumn("ticker_source", F.when(F.col("ticker").isNotNull(), "filing"))


def complete_tickers(events: DataFrame, issuers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Events with a ticker from the filing or the issuer's current one, and exclusions with their reason.

    issuers: cik, current (the first usable symbol of the issuer, NULL if it has none).
    """
    joined = events.join(issuers.withColumn("_known", F.lit(True)), "cik", "left")
    full = joined.withColumn("ticker_source", F.when(F.col("ticker").isNotNull(), F.coalesce("ticker_source", F.lit("filing"))).when(F.col("current").isNotNull(), "current"))
    full = full.withColumn("ticker", F.coalesce("ticker", "current"))
    reason = F.when(F.col("_known").isNull(), "issuer not found").otherwise("issuer has no listed symbol")
    gone = full.filter(F.col("ticker").isNull()).select("accession_no", "cik", reason.alias("reason"))
    return full.filter(F.col("ticker").isNotNull()).drop("current", "_known"), gone


def classify_cells(rows: DataFrame, filing: str, required: Sequence[str], optional: Sequence[str]) -> DataFrame:
    """filing, rejected: a filing with any unreadable required or present-but-bad optional cell is lost whole."""
    bad: Column = F.lit(False)
    for c in required:
        bad = bad | text.strict_decimal(F.col(c).cast("string")).isNull()
    for c in optional:
        bad = bad | text.bad_optional_decimal(F.col(c).cast("string"))
    return rows.groupBy(filing).agg(F.bool_or(bad).alias("rejected"))
