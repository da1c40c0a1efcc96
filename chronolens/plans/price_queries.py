"""Queries over bars and labels. Windows are shortened where the tables are short (30 sessions)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import prices
from .roles import BARS, FILINGS, bars, filings

HORIZON = 5
BENCHMARK = "view"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.col("transaction_code")
    symbol = F.when(code == "P", "purchase").when(code == "S", "signup").when(code == "M", "click").when(code == "A", "view").otherwise("error")
    return filings(spark, sf_dir).select("accession_no", symbol.alias("symbol"), "day", "as_of").filter("symbol <> 'view'")


def _benchmarks(spark: SparkSession) -> DataFrame:
    return spark.sql("SELECT explode(array('purchase', 'signup', 'click', 'error')) AS symbol, 'view' AS benchmark")


def daily_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars(spark, sf_dir).withColumn("session", F.col("session").cast("string"))


def closed_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions closed at each filing (21:00 UTC in January), over the last ten days."""
    series = prices.numbered(bars(spark, sf_dir))
    rows = _events(spark, sf_dir).withColumn("day", F.when(F.date_format("as_of", "HH:mm:ss") >= "21:00:00", F.col("day")).otherwise(F.date_sub("day", 1)))
    last = prices.last_closed(rows, series, ["idx"]).filter("idx IS NOT NULL")
    return last.groupBy("symbol").agg(F.count(F.lit(1)).alias("events"), F.sum("idx").cast("long").alias("bars"))


def entry_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    series = prices.numbered(bars(spark, sf_dir))
    entry = prices.next_session(_events(spark, sf_dir), series, ["session", "open"]).filter("session IS NOT NULL")
    return entry.select("accession_no", F.col("session").cast("string").alias("session"), "open")


def paired_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    pair = prices.paired(bars(spark, sf_dir), _benchmarks(spark))
    return pair.select("symbol", F.col("session").cast("string").alias("session"), F.col("idx").cast("long").alias("idx"), "open", "close", "benchmark_open", "benchmark_close")


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prices.label_events(_events(spark, sf_dir), bars(spark, sf_dir), _benchmarks(spark), HORIZON)


def abnormal_return(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _labelled(spark, sf_dir).filter("reason IS NULL")
    return rows.select("accession_no", F.col("entry_session").cast("string").alias("entry_session"), F.col("exit_session").cast("string").alias("exit_session"), F.round(F.col("abnormal_return").cast("double"), 9).alias("abnormal_return"))


def unmeasurable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _labelled(spark, sf_dir).filter("reason IS NOT NULL").groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def window_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = prices.window_plan(_events(spark, sf_dir).withColumn("end", F.date_add("day", 9)), "day", "end")
    return plan.select("symbol", F.col("start").cast("string").alias("start"), F.col("end").cast("string").alias("end"), "events")


def day_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir).withColumn("end", F.date_add("day", 9))
    return prices.day_window(rows, "day", "end", F.to_date(F.lit("2024-02-01"))).select(F.col("start").cast("string").alias("first_day"), F.col("end").cast("string").alias("last_day"))


def session_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = prices.session_statistics(bars(spark, sf_dir), trailing=10, volumes=15)
    nine = [F.round(c, 9).alias(c) for c in ("trailing_return", "realised_volatility", "volume_midrank")]
    return s.select("symbol", F.col("session").cast("string").alias("session"), *nine)


def dollar_volume_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = prices.median_dollar_volume(bars(spark, sf_dir), 20).filter("dollar_volume IS NOT NULL")
    return s.select("symbol", F.col("session").cast("string").alias("session"), F.round("dollar_volume", 6).alias("dollar_volume"))


def packet_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars of the ten days before each filing day, rendered in order; once a symbol and day."""
    days = _events(spark, sf_dir).select("symbol", "day").distinct()
    spread = days.select("symbol", "day", F.explode(F.sequence(F.date_sub("day", 10), F.date_sub("day", 1))).alias("session"))
    kept = spread.join(bars(spark, sf_dir).select("symbol", "session", "volume"), ["symbol", "session"])
    packed = kept.groupBy("symbol", "day").agg(F.array_sort(F.collect_list(F.struct("session", "volume"))).alias("bars"))
    text = F.array_join(F.transform("bars", lambda b: F.concat_ws(":", b["session"].cast("string"), b["volume"].cast("string"))), " ")
    return packed.select("symbol", F.col("day").cast("string").alias("day"), text.alias("bars"))


_E = f"""{FILINGS}, ev AS (SELECT accession_no, day, as_of, CASE transaction_code WHEN 'P' THEN 'purchase' WHEN 'S' THEN 'signup' WHEN 'M' THEN 'click' ELSE 'error' END AS symbol FROM filings WHERE transaction_code <> 'A')"""
_PAIR = "pair AS (SELECT b.symbol, b.session, b.open, b.close, v.open AS bo, v.close AS bc FROM bars b JOIN bars v ON v.session = b.session AND v.symbol = 'view' WHERE b.symbol <> 'view')"
_LABEL = f"""WITH {_E}, {BARS}, {_PAIR}, p AS (
  SELECT *, lead(session, 5) OVER w AS exit_session, lead(close, 5) OVER w AS exit_close, lead(bc, 5) OVER w AS exit_bc FROM pair WINDOW w AS (PARTITION BY symbol ORDER BY session)
), l AS (SELECT e.accession_no, p.session AS entry_session, p.exit_session, (p.exit_close - p.open) / p.open - (p.exit_bc - p.bo) / p.bo AS ret
  FROM ev e ASOF JOIN p ON p.symbol = e.symbol AND e.day < p.session WHERE p.exit_session IS NOT NULL)"""

QUERIES = {
    f.__name__: f
    for f in (
        daily_bars, closed_bars, entry_session, paired_bars, abnormal_return, unmeasurable, window_plan, day_window, session_statistics, dollar_volume_median, packet_bars,
    )
}
ORACLE_SQL = {
    "daily_bars": f"WITH {BARS} SELECT symbol, CAST(session AS VARCHAR) AS session, open, high, low, close, volume FROM bars",
    "closed_bars": f"WITH {_E}, {BARS}, c AS (SELECT e.symbol, e.accession_no, count(*) AS n FROM ev e JOIN bars b ON b.symbol = e.symbol AND b.session + INTERVAL 21 HOUR <= e.as_of GROUP BY ALL) SELECT symbol, count(*) AS events, sum(n)::BIGINT AS bars FROM c GROUP BY symbol",
    "entry_session": f"WITH {_E}, {BARS} SELECT e.accession_no, CAST(b.session AS VARCHAR) AS session, b.open FROM ev e JOIN bars b ON b.symbol = e.symbol AND b.session > e.day QUALIFY row_number() OVER (PARTITION BY e.accession_no ORDER BY b.session) = 1",
    "paired_bars": f"WITH {BARS}, {_PAIR} SELECT symbol, CAST(session AS VARCHAR) AS session, row_number() OVER (PARTITION BY symbol ORDER BY session) AS idx, open, close, bo AS benchmark_open, bc AS benchmark_close FROM pair",
    "abnormal_return": f"{_LABEL} SELECT accession_no, CAST(entry_session AS VARCHAR) AS entry_session, CAST(exit_session AS VARCHAR) AS exit_session, round(ret, 9) AS abnormal_return FROM l",
    "unmeasurable": f"""{_LABEL}, n AS (SELECT e.accession_no, (SELECT count(*) FROM bars b WHERE b.symbol = e.symbol AND b.session > e.day) AS own, (SELECT count(*) FROM bars b WHERE b.symbol = 'view' AND b.session > e.day) AS base FROM ev e)
SELECT CASE WHEN own < 6 THEN 'issuer series too short' WHEN base < 6 THEN 'benchmark series too short' ELSE 'too few common sessions' END AS reason, count(*) AS n FROM n ANTI JOIN l USING (accession_no) GROUP BY 1""",
    "window_plan": f"WITH {_E} SELECT symbol, CAST(min(day) AS VARCHAR) AS start, CAST(max(day + 9) AS VARCHAR) AS \"end\", count(*) AS events FROM ev GROUP BY symbol",
    "day_window": f"WITH {_E} SELECT CAST(min(day) AS VARCHAR) AS first_day, CAST(least(max(day + 9), DATE '2024-01-31') AS VARCHAR) AS last_day FROM ev",
    "session_statistics": f"""WITH {BARS}, r AS (SELECT *, ln(close / lag(close) OVER w) AS lr, lag(close, 10) OVER w AS c10, list(volume) OVER (PARTITION BY symbol ORDER BY session ROWS BETWEEN 14 PRECEDING AND 1 PRECEDING) AS ev FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY session)),
s AS (SELECT *, stddev_samp(lr) OVER (PARTITION BY symbol ORDER BY session ROWS 9 PRECEDING) AS sd FROM r)
SELECT symbol, CAST(session AS VARCHAR) AS session, round(close / c10 - 1, 9) AS trailing_return, CASE WHEN c10 IS NOT NULL THEN round(sd * sqrt(252.0), 9) END AS realised_volatility,
  CASE WHEN len(ev) = 14 THEN round((len(list_filter(ev, lambda v: v < volume)) + len(list_filter(ev, lambda v: v = volume)) / 2.0) / 14.0, 9) END AS volume_midrank FROM s""",
    "dollar_volume_median": f"""WITH {BARS}, d AS (SELECT symbol, session, median(close * volume) OVER w AS m, count(*) OVER w AS n FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY session ROWS 19 PRECEDING))
SELECT symbol, CAST(session AS VARCHAR) AS session, round(m, 6) AS dollar_volume FROM d WHERE n = 20""",
    "packet_bars": f"""WITH {_E}, {BARS}, d AS (SELECT DISTINCT symbol, day FROM ev)
SELECT d.symbol, CAST(d.day AS VARCHAR) AS day, string_agg(CAST(b.session AS VARCHAR) || ':' || b.volume, ' ' ORDER BY b.session) AS bars FROM d JOIN bars b ON b.symbol = d.symbol AND b.session BETWEEN d.day - 10 AND d.day - 1 GROUP BY ALL""",
}
