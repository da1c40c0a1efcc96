"""How the generic tables stand in for filings, bars and outcomes, once for Spark and once as SQL text.

events as filings: event_id is the accession number, ts the acceptance time, user_id the issuer, the event type the
transaction code (purchase P, signup S, others no open-market trade), value the traded value, props.k the shares. The
insider is one of seven per issuer; every fifth filing is under a trading plan. Forecast and return are fixed functions
of the row. events as bars: the event type is the symbol and the date the session. documents with labels stand for
texts with outcomes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

POSITIONS = ("Chief Executive Officer", "Director", "10% Owner", "VP, Director", "Trustee")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    kind = F.col("event_type")
    code = F.when(kind == "purchase", "P").when(kind == "signup", "S").when(kind == "click", "M").when(kind == "view", "A").otherwise("F")
    return e.select(
        F.col("event_id").alias("accession_no"), F.col("ts").cast("timestamp").alias("as_of"), F.to_date("ts").alias("day"),
        F.col("user_id").alias("cik"), code.alias("transaction_code"), F.col("value").alias("value_usd"),
        F.get_json_object("props", "$.k").cast("long").alias("shares"), (F.col("event_id") % 4 * 10).alias("remaining_shares"),
        F.concat(F.lit("insider "), (F.col("event_id") % 7).cast("string")).alias("insider_name"),
        (F.col("event_id") % 5 == 0).alias("is_plan"),
        F.element_at(F.array(*[F.lit(p) for p in POSITIONS]), (F.col("event_id") % 5 + 1).cast("int")).alias("position"),
        (F.col("value") / 500).alias("forecast"),
        ((F.col("event_id") * 7919 % 10007) / F.lit(10007.0) - 0.47).alias("abnormal_return"),
        F.date_add(F.to_date("ts"), (F.col("event_id") % 6 + 1).cast("int")).alias("exit_session"),
    )


FILINGS = """filings AS (
  SELECT event_id AS accession_no, ts AS as_of, CAST(ts AS DATE) AS day, user_id AS cik,
    CASE event_type WHEN 'purchase' THEN 'P' WHEN 'signup' THEN 'S' WHEN 'click' THEN 'M' WHEN 'view' THEN 'A' ELSE 'F' END AS transaction_code,
    value AS value_usd, CAST(json_extract_string(props, '$.k') AS BIGINT) AS shares, event_id % 4 * 10 AS remaining_shares,
    'insider ' || (event_id % 7) AS insider_name, event_id % 5 = 0 AS is_plan,
    ['Chief Executive Officer', 'Director', '10% Owner', 'VP, Director', 'Trustee'][event_id % 5 + 1] AS position,
    value / 500 AS forecast, (event_id * 7919 % 10007) / 10007.0::DOUBLE - 0.47::DOUBLE AS abnormal_return,
    CAST(ts AS DATE) + CAST(event_id % 6 + 1 AS INTEGER) AS exit_session
  FROM events
)"""


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").withColumn("session", F.to_date("ts"))
    at = F.struct("ts", "event_id")
    return e.groupBy(F.col("event_type").alias("symbol"), "session").agg(
        F.min_by("value", at).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", at).alias("close"),
        F.sum(F.get_json_object("props", "$.k").cast("long")).alias("volume"),
    )


BARS = """bars AS (
  SELECT event_type AS symbol, CAST(ts AS DATE) AS session,
    first(value ORDER BY ts, event_id) AS open, max(value) AS high, min(value) AS low, last(value ORDER BY ts, event_id) AS close,
    CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS volume
  FROM events GROUP BY ALL
)"""


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, lang, p (a fixed forecast) and y (quality) of labelled documents."""
    d, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    return d.join(labels, "doc_id").select("doc_id", "lang", ((F.col("n_chars") * 31 + F.col("doc_id")) % 1000 / 1000.0).alias("p"), F.col("quality").cast("double").alias("y"))


JUDGED = """judged AS (
  SELECT doc_id, lang, ((n_chars * 31 + doc_id) % 1000) / 1000.0::DOUBLE AS p, quality::DOUBLE AS y FROM documents JOIN labels USING (doc_id)
)"""

SCORES = """scores AS (
  SELECT day, cik, avg(forecast) AS forecast, avg(abnormal_return) AS abnormal_return, count(*) AS filings,
    CAST(avg(abnormal_return) > 0 AS INTEGER) AS rose FROM filings GROUP BY day, cik
)"""


def ic_sql(source: str, keys: str, name: str = "daily", having: int = 10) -> str:
    """SQL for the rank correlation of forecast and abnormal_return of `source` within keys."""
    return f"""{name}_r AS (
  SELECT {keys}, (2 * rank() OVER (PARTITION BY {keys} ORDER BY forecast) + count(*) OVER (PARTITION BY {keys}, forecast) - 1)::DOUBLE AS x,
    (2 * rank() OVER (PARTITION BY {keys} ORDER BY abnormal_return) + count(*) OVER (PARTITION BY {keys}, abnormal_return) - 1)::DOUBLE AS y
  FROM {source}
), {name} AS (
  SELECT {keys}, count(*) AS n, CASE WHEN count(*) * sum(x * x) > sum(x) * sum(x) AND count(*) * sum(y * y) > sum(y) * sum(y) THEN
    (count(*) * sum(x * y) - sum(x) * sum(y)) / sqrt((count(*) * sum(x * x) - sum(x) * sum(x)) * (count(*) * sum(y * y) - sum(y) * sum(y))) END AS ic
  FROM {name}_r GROUP BY {keys} HAVING count(*) >= {having}
)"""
