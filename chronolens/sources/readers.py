"""Readers of captured sources: filings, reports, cover facts, bars, news, trade history, call streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text, times
from ..operators import calls, events, prices
from . import schemas
from .archives import ArchiveMembers


def form4_filings(spark: SparkSession, path: str) -> DataFrame:
    """One row a transaction row of each filing, cells as text, with the sorted owner numbers."""
    raw = spark.read.schema(schemas.FORM4_FILING).json(path, multiLine=True)
    owners = F.coalesce(events.owner_set(F.transform("reporting_owners", lambda o: o["cik"])), F.array().cast("array<long>"))
    rows = raw.select("accession_no", "cik", "company", F.col("aff10b5_one").alias("is_plan"), "as_of", owners.alias("owner_ciks"), F.explode("rows").alias("r"))
    return rows.select("accession_no", "cik", "company", "is_plan", times.iso_instant(F.col("as_of")).alias("as_of"), "owner_ciks", "r.*")


def insider_events(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Events, and filings lost whole with their reason, from form-4 rows.

    Rows without any value are no transactions. Transactions that joint owners repeat count once, compared as text. One
    unreadable cell or unusable symbol loses the whole filing.
    """
    present = events.present_rows(rows)
    one = events.dedupe_first(present, ["accession_no", *events.TRANSACTION_KEY], ["Position"])
    bad = text.strict_decimal(F.col("Shares")).isNull()
    for c in ("Price", "Value", "Remaining Shares"):
        bad = bad | text.bad_optional_decimal(F.col(f"`{c}`"))
    unlisted = ~text.is_tradeable(F.col("Ticker"))
    judged = one.withColumn("_reason", F.when(F.col("as_of").isNull(), "no acceptance time").when(unlisted, "unpriceable issuer").when(bad, "unreadable cell"))
    lost = judged.groupBy("accession_no").agg(F.min("_reason").alias("reason")).filter("reason IS NOT NULL")
    kept = judged.join(lost.select("accession_no"), "accession_no", "left_anti")
    out = kept.select(
        "accession_no", "as_of", "cik", text.tradeable_symbol(F.col("Ticker")).alias("ticker"), F.col("Issuer").alias("issuer"), F.col("Insider").alias("insider_name"),
        F.col("Position").alias("position"), F.upper(text.stripped(F.col("Code"))).alias("transaction_code"), text.strict_decimal(F.col("Shares")).alias("shares"),
        *[text.strict_decimal(F.col(f"`{c}`")).alias(a) for c, a in (("Price", "price"), ("Value", "value_usd"), ("Remaining Shares", "remaining_shares"))],
        "is_plan", "owner_ciks",
    )
    return out, lost


def current_reports(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.CURRENT_REPORT).json(path, multiLine=True)


def cover_facts(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.schema(schemas.COVER_FACTS).json(path, multiLine=True)
    return raw.select("accession_no", F.posexplode("rows").alias("seq", "r")).select("accession_no", "seq", "r.*")


def daily_bars(spark: SparkSession, path: str) -> DataFrame:
    """Long bars from pages of the bars service; a symbol that a page lacks has no rows."""
    raw = spark.read.text(path, wholetext=True).select(F.get_json_object("value", "$.bars").alias("bars"))
    return prices.parse_bars(raw)


def news(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.schema(schemas.NEWS).json(path, multiLine=True).select(F.explode("news").alias("n")).select("n.*")
    return raw.withColumns({c: times.iso_instant(F.col(c)) for c in ("created_at", "updated_at")})


def history_archives(spark: SparkSession, pattern: str) -> dict[str, DataFrame]:
    """The three members of every quarterly archive that history needs, each inflated once for the columns named here."""
    spark.dataSource.register(ArchiveMembers)

    def member(name: str, *columns: str) -> DataFrame:
        schema = ", ".join(f"{c} string" for c in columns)
        return spark.read.format("tsv_archives").schema(schema).option("member", name).load(pattern)

    submissions = member("SUBMISSION", "quarter", "ACCESSION_NUMBER", "FILING_DATE", "DOCUMENT_TYPE", "ISSUERCIK")
    trades = member("NONDERIV_TRANS", "ACCESSION_NUMBER", "TRANS_DATE", "TRANS_CODE")
    owners = member("REPORTINGOWNER", "ACCESSION_NUMBER", "RPTOWNERCIK")
    number = F.col("ACCESSION_NUMBER").alias("accession_no")
    return {
        "submissions": submissions.select(number, F.col("DOCUMENT_TYPE").alias("form"), text.filing_date(F.col("FILING_DATE")).alias("filed"), F.col("ISSUERCIK").try_cast("long").alias("issuer"), "quarter"),
        "transactions": trades.select(number, F.col("TRANS_CODE").alias("code"), text.filing_date(F.col("TRANS_DATE")).alias("traded")),
        "owners": owners.select(number, F.col("RPTOWNERCIK").try_cast("long").alias("owner")),
    }


def quarters(history: dict[str, DataFrame]) -> DataFrame:
    return history["submissions"].agg(F.min("quarter").alias("first"), F.max("quarter").alias("last"))


def call_streams(spark: SparkSession, path: str) -> DataFrame:
    """call (the file's name) and numbered lines of captured call streams."""
    whole = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.[^./]*)?$", 1).alias("call"), F.col("value").alias("text"))
    return calls.call_lines(whole)


def filing_index(rows: DataFrame, calendar: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The first record of each accession in index order, and trading days without any (a read failure, not a quiet day)."""
    records = events.dedupe_first(rows, ["accession_no"], ["seq"])
    empty = calendar.filter("trading").select("day").join(rows.select(F.col("filing_date").alias("day")).distinct(), "day", "left_anti")
    return records, empty
