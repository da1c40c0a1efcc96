"""Queries over packets, series and call streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import packets
from .roles import BARS, FILINGS, bars, filings


def _packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filings with one bar: of the day before, but of the same day where the number ends in 3; a case resolved later for every 50th."""
    session = F.when(F.col("accession_no") % 10 == 3, F.col("day")).otherwise(F.date_sub("day", 1))
    case = F.when(F.col("accession_no") % 50 == 0, F.array(F.struct(F.date_add("day", 2).cast("timestamp").alias("resolved_at")))).otherwise(F.array().cast("array<struct<resolved_at:timestamp>>"))
    return filings(spark, sf_dir).select(F.col("accession_no").alias("event_id"), "cik", "as_of", F.array(F.struct(session.alias("session"))).alias("bars"), case.alias("comparables"), F.array().cast("array<string>").alias("sections"), F.when(F.col("accession_no") % 30 == 7, "redflag").otherwise("insider").alias("domain"))


def lookahead_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packets.lookahead(_packets(spark, sf_dir)).select("event_id")


def unrenderable_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packets.unrenderable(_packets(spark, sf_dir)).select("event_id")


def series_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = bars(spark, sf_dir).select("symbol", "session", "close")
    other = base.filter("symbol IN ('view', 'click')").withColumn("close", F.col("close") + 1)
    return packets.series_union(base.filter("symbol <> 'view'"), other).withColumn("session", F.col("session").cast("string"))


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two packets a filing number, as if each had two transactions."""
    rows = filings(spark, sf_dir).select((F.col("accession_no") - F.col("accession_no") % 2).alias("event_id"), "cik", "as_of", F.sha2(F.col("accession_no").cast("string"), 256).alias("content_hash"), "transaction_code")
    return rows


def first_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packets.first_packets(_rows(spark, sf_dir))


def issuer_day_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = packets.rendered(packets.issuer_day_groups(packets.sanitised_packets(_rows(spark, sf_dir), ["transaction_code"], [])), ["transaction_code"])
    return groups.select("cik", F.col("entry_day").cast("string").alias("entry_day"), "before_open", "issuer_day_hash", F.array_join(F.transform("event_ids", lambda x: x.cast("string")), ",").alias("event_ids"), "prompt")


_ROWS = f"{FILINGS}, r AS (SELECT accession_no - accession_no % 2 AS event_id, cik, as_of, sha256(CAST(accession_no AS VARCHAR)) AS h, transaction_code AS code, (as_of AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York' AS local FROM filings)"
QUERIES = {f.__name__: f for f in (lookahead_packets, unrenderable_packets, series_union, first_packets, issuer_day_prompts)}
ORACLE_SQL = {
    "lookahead_packets": f"""WITH {FILINGS} SELECT accession_no AS event_id FROM filings
WHERE ((CASE WHEN accession_no % 10 = 3 THEN day ELSE day - 1 END) + INTERVAL 16 HOUR) AT TIME ZONE 'America/New_York' > as_of AT TIME ZONE 'UTC' OR accession_no % 50 = 0""",
    "unrenderable_packets": f"WITH {FILINGS} SELECT accession_no AS event_id FROM filings WHERE accession_no % 30 = 7 OR accession_no % 50 = 0",
    "series_union": f"WITH {BARS} SELECT symbol, CAST(session AS VARCHAR) AS session, CASE WHEN symbol IN ('view', 'click') THEN close + 1 ELSE close END AS close FROM bars",
    "first_packets": f"WITH {_ROWS} SELECT event_id, h AS content_hash FROM r QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY as_of, h) = 1",
    "issuer_day_prompts": f"""WITH {_ROWS}, g AS (SELECT cik, CAST(local AS DATE) AS d, CAST(local AS TIME) < TIME '09:30:00' AS early, * EXCLUDE (cik) FROM r),
e AS (SELECT cik, d, early, event_id, min((as_of, event_id, h)) AS k FROM g GROUP BY ALL),
n AS (SELECT cik, d, early, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY k) AS event_ids FROM e GROUP BY ALL),
hh AS (SELECT cik, d, early, sha256(string_agg(h, chr(10) ORDER BY h)) AS issuer_day_hash FROM (SELECT DISTINCT cik, d, early, h FROM g) GROUP BY ALL),
p AS (SELECT cik, d, early, '<untrusted_data>' || chr(10) || string_agg('- accepted ' || strftime(as_of, '%Y-%m-%dT%H:%M:%S+00:00') || ' | transaction_code ' || code, chr(10) ORDER BY as_of, event_id, h) || chr(10) || '</untrusted_data>' AS prompt FROM g GROUP BY ALL)
SELECT cik, CAST(d AS VARCHAR) AS entry_day, early AS before_open, issuer_day_hash, event_ids, prompt FROM n JOIN hh USING (cik, d, early) JOIN p USING (cik, d, early)""",
}
