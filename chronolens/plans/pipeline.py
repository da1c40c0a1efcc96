"""The steps of a day: ingest, label, freeze packets; each replaces its partition or writes nothing."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import canonical, canonical_sql, sectors, times
from ..operators import calendar, events, guards, prices
from ..sources import readers, schemas
from ..sources.store import Store
from .backfill import WindowsStillOpenError

HISTORY_DAYS = 120


class OpenDayError(guards.GuardError):
    """A trading day without a single filing: a read failure, not a quiet day."""


def ingest_day(store: Store, form4_rows: DataFrame, day: str, floor: float = events.DEFAULT_FLOOR) -> dict[str, int]:
    """Store the day's screened trades. Rejections are written before any guard may stop the day; a trading day without a filing is none."""
    attempted = form4_rows.select("accession_no").distinct().count()
    if not attempted and calendar.is_trading_day(dt.date.fromisoformat(day)):
        raise OpenDayError(f"no filing was listed on {day}, a trading day")
    found, lost = readers.insider_events(form4_rows)
    reasons = {r["reason"]: r["count"] for r in lost.groupBy("reason").count().collect()}
    store.replace(lost.select("accession_no", F.lit(None).cast("string").alias("ticker"), "reason"), "insider", day, schemas.EXCLUSION, "exclusions")
    late, unlisted = reasons.get("no acceptance time", 0), reasons.get("unpriceable issuer", 0)
    if guards.parse_breakage(reasons.get("unreadable cell", 0), attempted - late, unlisted, late):
        raise guards.GuardError(f"{reasons} of {attempted} filings were rejected on {day}")
    kept = store.replace(events.insider_screen(found, floor).withColumnRenamed("is_plan", "is_10b5_1"), "insider", day, schemas.INSIDER_EVENT)
    return {"events": kept, "rejected": reasons.get("unreadable cell", 0) + late, "unpriceable": unlisted}


def ingest_reports(store: Store, reports: DataFrame, facts: DataFrame, day: str) -> dict[str, int]:
    """Store the day's red-flag reports; cover pages are read for qualifying reports only. A report without any captured fact is a failed read."""
    flagged = events.redflag_events(reports)
    named = {"as_of": "timestamp", "issuer": "string", "has_press_release": "boolean"}
    flagged = flagged.withColumns({c: F.lit(None).cast(t) for c, t in named.items() if c not in flagged.columns})
    reads = flagged.select("accession_no").distinct()
    failed = reads.join(facts.select("accession_no"), "accession_no", "left_anti").count()
    if guards.ticker_reads_broken(failed, total := reads.count()):
        raise guards.GuardError(f"{failed} of {total} cover pages of {day} could not be read")
    wanted = facts.join(flagged.select("accession_no", "cik"), "accession_no")
    securities = events.cover_securities(wanted).join(flagged.select("accession_no", "cik"), "accession_no")
    return {"events": store.replace(events.with_ticker(flagged, events.choose_ticker(securities)), "redflag", day, schemas.REDFLAG_EVENT)}


def resolve_day(store: Store, domain: str, day: str, bars: DataFrame, issuers: DataFrame, today: dt.date) -> dict[str, int]:
    """Label a stored day once every window is closed. issuers: cik, sic, current (usable symbol)."""
    spark, span = store.spark, schemas.horizon(domain)
    schema = schemas.INSIDER_EVENT if domain == "insider" else schemas.REDFLAG_EVENT
    rows = store.read(domain, day, schema).select("accession_no", "cik", "ticker", "as_of").distinct().withColumn("ticker_source", F.lit(None).cast("string"))
    rows = rows.withColumn("day", times.eastern_date(F.col("as_of")))
    year = int(day[:4])
    sessions = calendar.trading_calendar(spark, f"{year}-01-01", f"{min(year + 1, max(calendar.COVERED_YEARS))}-12-31")
    open_ = calendar.window_close(rows, sessions, span).filter(F.coalesce(F.col("closes_on") >= F.lit(today), F.lit(True)))
    if open_.limit(1).count():
        raise WindowsStillOpenError(f"outcome windows of {domain} on {day} are still open on {today}")
    priced, gone = events.complete_tickers(rows, issuers.select("cik", "current"))
    funds = priced.join(issuers.select("cik", "sic"), "cik").select(F.col("ticker").alias("symbol"), sectors.sector_fund(F.col("sic")).alias("benchmark")).distinct()
    guards.none_left(funds.select(F.col("benchmark").alias("symbol")).distinct().join(bars, "symbol", "left_anti"), "a benchmark has no prices")
    labelled = prices.label_events(priced.withColumnRenamed("ticker", "symbol"), bars, funds.dropDuplicates(["symbol"]), span)
    counts = labelled.agg(F.count_if(F.col("reason").isNotNull()).alias("bad"), F.count(F.lit(1)).alias("all")).first()
    if guards.labels_broken(counts["bad"] or 0, counts["all"]):
        raise guards.GuardError(f"{counts['bad']} of {counts['all']} events of {day} cannot be measured")
    bad = labelled.filter("reason IS NOT NULL").select("accession_no", F.col("symbol").alias("ticker"), "reason")
    store.replace(bad.unionByName(gone.select("accession_no", F.lit(None).cast("string").alias("ticker"), "reason")), domain, day, schemas.EXCLUSION, "label-exclusions")
    good = labelled.filter("reason IS NULL").select("accession_no", "abnormal_return", F.col("benchmark").alias("benchmark_symbol"), F.lit(span).cast("long").alias("horizon_days"), "entry_session", "exit_session", "ticker_source")
    return {"labels": store.replace(good, domain, day, schemas.LABEL, "labels"), "excluded": counts["bad"] or 0}


def build_packets(store: Store, rows: DataFrame, bars: DataFrame, day: str) -> DataFrame:
    """canonical and content_hash of each event's evidence: named fields and the bars closed at its acceptance, 120 days back.

    Bars are gathered once a symbol and closing day. An event without evidence is stored as excluded with its reason.
    """
    at = times.eastern_date(F.col("as_of"))
    evening = times.session_close(at) <= F.col("as_of")
    known = rows.withColumns({"_first": F.date_sub(at, HISTORY_DAYS), "_last": F.when(evening, at).otherwise(F.date_sub(at, 1))})
    span = ["ticker", "_first", "_last"]
    spread = known.select(*span).distinct().select(*span, F.explode(F.sequence("_first", "_last")).alias("session"))
    bar = F.struct("session", *[F.col(c).cast(prices.PRICE).alias(c) for c in ("open", "high", "low", "close", "volume")])
    series = spread.join(bars.withColumnRenamed("symbol", "ticker"), ["ticker", "session"]).groupBy(*span).agg(F.array_sort(F.collect_list(bar)).alias("bars"))
    fields = ["accession_no", "as_of", "cik", "ticker", "insider_name", "transaction_code"]
    reason = (
        F.when(F.col("bars").isNull(), F.concat(F.lit("no price history for "), F.coalesce("ticker", F.lit("an unnamed symbol")), F.lit(" before the event")))
        .when(F.exists("bars", lambda b: ~F.coalesce(b["close"] > 0, F.lit(False))), "a close is not a price")
    )
    judged = known.select(*fields, "_first", "_last").distinct().join(series, span, "left").withColumn("_reason", reason)
    gone = judged.filter("_reason IS NOT NULL").select("accession_no", "ticker", F.col("_reason").alias("reason")).distinct()
    store.replace(gone, "insider", day, schemas.EXCLUSION, "packet-exclusions")
    packed = judged.filter("_reason IS NULL").select(*fields, "bars")
    summary = canonical.exact_summary(F.transform("bars", lambda b: b["close"]), F.transform("bars", lambda b: b["volume"]))
    summed = packed.withColumn("summary", summary)
    packet = summed.select("accession_no", canonical_sql.canonical_packet(summed, *fields, "bars", "summary").alias("canonical"))
    out = packet.withColumn("content_hash", canonical.hash_column(F.col("canonical")))
    store.write_packets(out, "insider", day)
    return out
