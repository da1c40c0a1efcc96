"""Queries over breakdowns, arm comparison, ledger, hashes and prompts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import canonical, canonical_sql, text
from ..operators import breakdowns, calls, ledger, metrics
from ..sources.commits import CommitLog, Field
from ..sources.scratch import scratch_path
from . import arm_ledger
from .roles import FILINGS, SCORES, filings, ic_sql, read


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.issuer_days(filings(spark, sf_dir))


def _sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every eleventh issuer states no figure."""
    return breakdowns.issuer_sizes(filings(spark, sf_dir).select("day", "cik", F.when(F.col("cik") % 11 != 0, F.col("value_usd")).alias("size")))


def _bucketed(spark: SparkSession, sf_dir: str) -> DataFrame:
    buckets = breakdowns.size_buckets(_sizes(spark, sf_dir))
    return _scores(spark, sf_dir).join(buckets, ["day", "cik"], "left")


def size_terciles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return breakdowns.size_buckets(_sizes(spark, sf_dir)).select(F.col("day").cast("string").alias("day"), "cik", "size", "bucket")


def ic_by_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _bucketed(spark, sf_dir)
    table, _ = breakdowns.ic_within_groups(rows, "bucket")
    out = table.join(breakdowns.contributing_medians(rows), "bucket")
    return out.select("bucket", "days", "issuer_days", *[F.round(c, 9).alias(c) for c in ("mean_ic", "error", "t", "median_size")])


def group_accounting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return breakdowns.ic_within_groups(_bucketed(spark, sf_dir), "bucket", min_per_day=44)[1]


def _history(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    o = read(spark, sf_dir, "orders")
    filed = F.to_date("o_orderdate")
    form = F.when(F.col("o_orderkey") % 9 == 0, "5").when(F.col("o_orderkey") % 9 == 1, "4/A").otherwise("4")
    submissions = o.select(F.col("o_orderkey").alias("accession_no"), form.alias("form"), filed.alias("filed"), (F.col("o_custkey") % 100).alias("issuer"))
    traded = F.when(F.col("o_orderkey") % 50 == 0, F.lit(None).cast("date")).when(F.col("o_orderkey") % 51 == 0, F.date_add(filed, 3)).otherwise(F.date_sub(filed, (F.col("o_orderkey") % 4).cast("int")))
    transactions = o.select(F.col("o_orderkey").alias("accession_no"), F.when(F.col("o_orderstatus") == "F", "P").when(F.col("o_orderstatus") == "O", "S").otherwise("A").alias("code"), traded.alias("traded"))
    owners = o.select(F.col("o_orderkey").alias("accession_no"), (F.col("o_custkey") % 30).alias("owner"))
    return breakdowns.history_trades(submissions, transactions, owners)


def history_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _history(spark, sf_dir)[0].groupBy("year", "month").agg(F.count(F.lit(1)).alias("trades"), F.count_distinct("owner").alias("owners"))


def history_skipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _history(spark, sf_dir)[1]


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("accession_no"), (F.col("o_custkey") % 30).alias("owner"), (F.col("o_custkey") % 100).alias("issuer"), F.to_date("o_orderdate").alias("accepted"))


def _pair_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _pairs(spark, sf_dir)
    known = breakdowns.pair_classes(rows.select("owner", "issuer", "accepted").distinct(), _history(spark, sf_dir)[0])
    return rows.join(known, ["owner", "issuer", "accepted"])


def pair_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pair_classes(spark, sf_dir).select("accession_no", "class")


def _event_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of one issuer and day stand for the owners of one filing."""
    own = _pair_classes(spark, sf_dir).withColumn("key", F.concat_ws("|", F.col("issuer").cast("string"), F.trunc("accepted", "month").cast("string")))
    return breakdowns.event_classes(own, "key")


def event_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _event_classes(spark, sf_dir)


def _day_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("accession_no") % 3 == 0, "routine").when(F.col("accession_no") % 3 == 1, "opportunistic").otherwise("unclassified")
    return breakdowns.issuer_day_classes(filings(spark, sf_dir).withColumn("class", kind))


def issuer_day_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _day_classes(spark, sf_dir).select(F.col("day").cast("string").alias("day"), "cik", "class")


def ic_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    table, _ = breakdowns.ic_by_type(_scores(spark, sf_dir), _day_classes(spark, sf_dir))
    return table.select("kind", "days", "issuer_days", *[F.round(c, 9).alias(c) for c in ("mean_ic", "error", "t")])


def type_accounting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return breakdowns.ic_by_type(_scores(spark, sf_dir), _day_classes(spark, sf_dir))[1]


def _comparison(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    base = filings(spark, sf_dir)
    other = base.filter("accession_no % 20 <> 0").select("accession_no", (F.col("shares") % 97 / 97.0).alias("forecast"))
    return breakdowns.compare_arms(base, other, "2024-01-05", "2024-01-25")


def arm_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _comparison(spark, sf_dir)[1]


def paired_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = _comparison(spark, sf_dir)[0]
    return days.select(F.col("day").cast("string").alias("day"), "n", *[F.round(c, 9).alias(c) for c in ("base_ic", "other_ic", "difference")])


def packet_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = (F.col("n_chars").cast("decimal(18,2)") / 4).cast("decimal(18,2)").alias("price")
    docs = read(spark, sf_dir, "documents").select("doc_id", "lang", F.col("doc_id").alias("event_id"), price, F.to_date(F.lit("2024-01-05")).alias("session"), F.lit(None).cast("string").alias("ticker"))
    rows = docs.select("doc_id", canonical_sql.canonical_packet(docs, "lang", "event_id", "price", "session", "ticker").alias("canonical"))
    return rows.select("doc_id", "canonical", canonical.hash_column(F.col("canonical")).alias("content_hash"))


def issuer_day_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations").select("conv_id", F.sha2("text", 256).alias("h"))
    return rows.groupBy("conv_id").agg(canonical.group_hash(F.col("h")).alias("group_hash"), F.count_distinct("h").alias("packets"))


def prompt_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat_ws(" | ", F.col("turn").cast("string"), text.sanitised(F.col("role")), text.sanitised(F.col("text"))).alias("line"))
    packed = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "line"))).alias("lines"))
    return packed.select("conv_id", F.array_join(F.transform("lines", lambda x: x["line"]), "\n").alias("prompt"))


def issuer_day_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.times import entry_key

    day, early = entry_key(F.col("as_of"))
    grouped = filings(spark, sf_dir).groupBy("cik", day.cast("string").alias("day"), early.alias("before_open"))
    return grouped.agg(F.count(F.lit(1)).alias("events"), F.min_by("accession_no", F.struct("as_of", "accession_no")).alias("first_event"))


def _usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as a call; models a and b, the latter for even events only."""
    payload = F.concat(
        F.lit('{"session_id":"x","total_cost_usd":"0.02","modelUsage":{"a":{"inputTokens":'), F.col("shares").cast("string"),
        F.lit(',"outputTokens":5,"cacheReadInputTokens":0,"cacheCreationInputTokens":0,"costUSD":"0.0125"}'), F.when(F.col("accession_no") % 2 == 0, ',"b":{"inputTokens":1,"outputTokens":0,"cacheReadInputTokens":7,"cacheCreationInputTokens":0,"costUSD":"0.001"}').otherwise(""), F.lit("}}"),
    )
    return ledger.model_usage(filings(spark, sf_dir).select(F.col("accession_no").alias("run_id"), "as_of", payload.alias("payload")))


def usage_by_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    totals = _usage(spark, sf_dir).groupBy("model").agg(F.count(F.lit(1)).alias("calls"), F.sum("input").alias("input"), F.sum("cache_read").alias("cache_read"), F.sum("cost_usd").cast("double").alias("cost"))
    return totals.withColumn("cost", F.round("cost", 6))


def spend_since(spark: SparkSession, sf_dir: str) -> DataFrame:
    spent = ledger.spend_since(_usage(spark, sf_dir), F.to_timestamp(F.lit("2024-01-20")), "as_of")
    return spent.select(F.round(F.col("spent").cast("double"), 6).alias("spent"))


def run_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.tokens_of(_usage(spark, sf_dir))


def exclusion_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "events").filter("event_type = 'error'").select(F.concat(F.lit("reason "), (F.col("user_id") % 4).cast("string")).alias("reason"))
    return ledger.exclusion_counts(rows)


def cost_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    usage = _usage(spark, sf_dir).withColumn("issuer_day_hash", F.col("run_id") % 500)
    forecasts = filings(spark, sf_dir).filter("accession_no % 3 = 0").select((F.col("accession_no") % 500).alias("issuer_day_hash"))
    return ledger.cost_of_forecasts(forecasts, usage).select("issuer_day_hash", F.round(F.col("cost").cast("double"), 6).alias("cost"))


def sample_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = filings(spark, sf_dir).withColumn("p", F.col("forecast") * 1.01)
    kind = F.when(F.col("accession_no") % 13 == 0, "boolean").otherwise("number")
    status = ledger.sample_status(F.col("p"), F.lit("r"), F.col("accession_no") % 17 == 0, F.col("accession_no") % 19 == 0, F.lit(False), kind)
    rows = rows.withColumn("status", status).withColumn("group", F.floor(F.col("accession_no") / 3))
    return ledger.sample_means(rows, ["group"]).select("group", F.round("forecast", 9).alias("forecast"))


def sample_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = filings(spark, sf_dir).withColumn("p", F.col("forecast") * 1.1)
    kind = F.when(F.col("accession_no") % 13 == 0, "boolean").otherwise("number")
    status = ledger.sample_status(F.col("p"), F.lit("r"), F.col("accession_no") % 17 == 0, F.col("accession_no") % 19 == 0, F.col("accession_no") % 23 == 0, kind)
    return rows.groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("n"))


def unique_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = filings(spark, sf_dir)
    return ledger.duplicates(rows.filter("accession_no % 2 = 0").select("cik", "day"), rows.filter("accession_no % 2 = 1").select("cik", "day"), ["cik", "day"]).select("cik", F.col("day").cast("string").alias("day"))


def append_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filings in two commits under one key, read back."""
    rows = filings(spark, sf_dir).select("accession_no", "cik")
    log = CommitLog(spark, scratch_path(spark, "ledger"))
    log.declare("filings", [Field("accession_no", "long", False), Field("cik", "long", False)], key=["accession_no"])
    for part in (0, 1):
        log.append({"filings": rows.filter(F.col("accession_no") % 2 == part)})
    return log.read("filings").groupBy("cik").agg(F.count(F.lit(1)).alias("n"))


def ledger_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metered calls appended under three declarations of their table, read as one."""
    rows = filings(spark, sf_dir).withColumn("shares", F.coalesce("shares", F.lit(0)))
    calls = rows.select(
        "accession_no", F.col("day").cast("string").alias("run_id"), F.col("transaction_code").alias("model"), F.col("shares").alias("input"), F.lit(1).alias("output"),
        F.col("remaining_shares").alias("cache_read"), F.col("cik").alias("issuer_day_hash"), (F.col("shares") * 3).alias("cache_write"), F.col("value_usd").alias("cost_usd"),
    )
    log = CommitLog(spark, scratch_path(spark, "ledger"))
    later = [[], ["issuer_day_hash"], ["issuer_day_hash", "cache_write"]]
    for step, added in enumerate(later):
        arm_ledger.upgrade(log, step + 1)
        log.append({"calls": calls.filter(F.col("accession_no") % 3 == step).select("run_id", "model", "input", "output", "cache_read", "cost_usd", *added)})
    return log.read("calls").groupBy("model", "issuer_day_hash").agg(F.count(F.lit(1)).alias("calls"), F.sum(F.expr("input + output + cache_read + cache_write")).alias("tokens"), F.sum("cost_usd").cast("double").alias("cost"))


def group_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = filings(spark, sf_dir).select(F.col("cik").alias("group"), F.col("accession_no").alias("event_id"), "day")
    states = ledger.group_state(rows.select("group", "event_id"), rows.filter("day < '2024-01-10' OR group % 10 = 0").filter("group % 10 <> 1").select("event_id"))
    return states.groupBy("state").agg(F.count(F.lit(1)).alias("n"))


def _call_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as streams of calls: the first turn tells what the start says, user turns are usage readings, the last turn is the result."""
    turns = read(spark, sf_dir, "conversations").withColumn("n", F.length("text"))
    last = F.max("turn").over(Window.partitionBy("conv_id"))
    tools = F.when(F.col("n") % 29 == 0, F.array(F.lit("StructuredOutput"), F.lit("Shell"))).otherwise(F.array(F.lit("StructuredOutput")))
    json = lambda *fields: F.to_json(F.struct(*fields))
    start = json(F.lit("system").alias("type"), F.lit("init").alias("subtype"), tools.alias("tools"), F.lit("m").alias("model"), F.lit("default").alias("output_style"), F.lit("default").alias("permissionMode"), F.lit("none").alias("apiKeySource"))
    state = F.when(F.col("n") % 37 == 0, "rejected").otherwise("allowed")
    use = F.struct(F.struct((F.col("n") / 1000).alias("utilization")).alias("five_hour"))
    reading = json(F.lit("rate_limit_event").alias("type"), F.struct(state.alias("status"), use.alias("unifiedWindows")).alias("rate_limit_info"))
    answer = F.struct((F.col("n") / 1500).alias("p_up"), F.col("text").alias("rationale"))
    result = json(F.lit("result").alias("type"), (F.col("n") % 11 == 0).alias("is_error"), F.when(F.col("n") % 13 == 0, "refusal").otherwise("end").alias("stop_reason"), answer.alias("structured_output"))
    lines = turns.withColumn("last", last).select("conv_id", "turn", F.explode(F.array(
        F.struct(F.lit(0).alias("k"), F.when(F.col("turn") == 0, start).alias("value")), F.struct(F.lit(1).alias("k"), F.when(F.col("role") == "user", reading).alias("value")),
        F.struct(F.lit(2).alias("k"), F.when(F.col("turn") % 2 == 1, F.col("text")).alias("value")), F.struct(F.lit(3).alias("k"), F.when((F.col("turn") == F.col("last")) & (F.col("turn") > 0), result).alias("value")),
    )).alias("l"))
    return lines.select(F.col("conv_id").alias("call"), (F.col("turn") * 4 + F.col("l.k")).alias("seq"), F.col("l.value").alias("value")).filter("value IS NOT NULL")


def call_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _call_streams(spark, sf_dir)
    ends = read(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("call")).agg((F.sum(F.length("text")) % 17 == 0).cast("int").alias("returncode")).withColumn("stderr", F.lit(None).cast("string"))
    judged = calls.judge_calls(calls.fold_calls(lines), ends, calls.Isolation("m"))
    return judged.select("call", "status", F.concat_ws(",", "problems").alias("problems"), F.round("estimate", 9).alias("estimate"), F.round(F.col("windows")["five_hour"], 9).alias("used"))


def running_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    so_far = Window.partitionBy("cik").orderBy("as_of", "accession_no").rowsBetween(Window.unboundedPreceding, 0)
    return filings(spark, sf_dir).select("accession_no", F.max("value_usd").over(so_far).alias("largest"))


def window_utilisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filings(spark, sf_dir).groupBy("transaction_code").agg(F.max_by("value_usd", F.struct("as_of", "accession_no")).alias("last_value"))


_SIZES = """sizes AS (SELECT * FROM (SELECT day, cik, max(CASE WHEN cik % 11 <> 0 THEN value_usd END) AS size FROM filings GROUP BY ALL) WHERE size IS NOT NULL),
buckets AS (SELECT *, ntile(3) OVER (PARTITION BY day ORDER BY size, cik) - 1 AS bucket FROM sizes)"""
_BUCKETED = f"{FILINGS}, {SCORES}, {_SIZES}, g AS (SELECT s.*, b.size, b.bucket, count(*) OVER (PARTITION BY s.day, b.bucket) AS gn FROM scores s LEFT JOIN buckets b USING (day, cik))"
_HIST = """s AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 9 = 0 THEN '5' WHEN o_orderkey % 9 = 1 THEN '4/A' ELSE '4' END AS form, CAST(o_orderdate AS DATE) AS filed, o_custkey % 100 AS issuer, o_custkey % 30 AS owner,
  CASE o_orderstatus WHEN 'F' THEN 'P' WHEN 'O' THEN 'S' ELSE 'A' END AS code,
  CASE WHEN o_orderkey % 50 = 0 THEN NULL WHEN o_orderkey % 51 = 0 THEN CAST(o_orderdate AS DATE) + 3 ELSE CAST(o_orderdate AS DATE) - CAST(o_orderkey % 4 AS INTEGER) END AS traded FROM orders),
t AS (SELECT * FROM s WHERE form IN ('4', '4/A') AND code IN ('P', 'S')),
h AS (SELECT DISTINCT owner, issuer, year(traded) AS year, month(traded) AS month, filed FROM t WHERE traded <= filed)"""
_PAIRSQL = f"""WITH {_HIST}, p AS (SELECT o_orderkey AS accession_no, o_custkey % 30 AS owner, o_custkey % 100 AS issuer, CAST(o_orderdate AS DATE) AS accepted FROM orders),
m AS (SELECT p.accession_no, h.month, count(DISTINCT h.year) AS years, list(DISTINCT h.year) AS own FROM p JOIN h ON h.owner = p.owner AND h.issuer = p.issuer AND h.filed < p.accepted AND h.year BETWEEN year(p.accepted) - 3 AND year(p.accepted) - 1 GROUP BY ALL),
y AS (SELECT accession_no, max(years) AS best, len(list_distinct(flatten(list(own)))) AS covered FROM m GROUP BY accession_no),
c AS (SELECT p.*, CASE WHEN coalesce(covered, 0) < 3 THEN 'unclassified' WHEN best = 3 THEN 'routine' ELSE 'opportunistic' END AS class FROM p LEFT JOIN y USING (accession_no))"""
_KIND = "CASE accession_no % 3 WHEN 0 THEN 'routine' WHEN 1 THEN 'opportunistic' ELSE 'unclassified' END"
_DAYCLASS = f"""k AS (SELECT day, cik, count(DISTINCT CASE WHEN {_KIND} <> 'unclassified' THEN {_KIND} END) AS n, min(CASE WHEN {_KIND} <> 'unclassified' THEN {_KIND} END) AS one FROM filings GROUP BY ALL),
dc AS (SELECT day, cik, CASE n WHEN 0 THEN 'unclassified' WHEN 1 THEN one ELSE 'mixed' END AS class FROM k)"""
_TYPED = f"{FILINGS}, {SCORES}, {_DAYCLASS}, g AS (SELECT s.*, CASE WHEN class IN ('routine', 'opportunistic') THEN class END AS kind, class FROM scores s LEFT JOIN dc USING (day, cik)), gg AS (SELECT *, count(*) OVER (PARTITION BY day, kind) AS gn FROM g)"
_CMP = f"""WITH {FILINGS}, d AS (SELECT day, cik, avg(forecast) AS base, avg(CASE WHEN accession_no % 20 <> 0 THEN (shares % 97) / 97.0::DOUBLE END) AS other, avg(abnormal_return) AS abnormal_return, bool_and(accession_no % 20 <> 0 AND shares IS NOT NULL) AS whole
  FROM filings WHERE day BETWEEN DATE '2024-01-05' AND DATE '2024-01-25' GROUP BY ALL), w AS (SELECT *, count(*) FILTER (whole) OVER (PARTITION BY day) AS n FROM d)"""
_USAGE = f"""WITH {FILINGS}, u AS (SELECT accession_no AS run_id, as_of, 'a' AS model, shares AS input, 5 AS output, 0 AS cache_read, 0.0125::DOUBLE AS cost FROM filings
  UNION ALL SELECT accession_no, as_of, 'b', 1, 0, 7, 0.001::DOUBLE FROM filings WHERE accession_no % 2 = 0)"""


def _status(scale: str, limited: str) -> str:
    return f"CASE WHEN {limited} THEN 'rate_limited' WHEN accession_no % 19 = 0 THEN 'error' WHEN accession_no % 17 = 0 THEN 'refused' WHEN accession_no % 13 <> 0 AND forecast * {scale} BETWEEN 0 AND 1 THEN 'ok' ELSE 'invalid' END"


QUERIES = {
    f.__name__: f
    for f in (
        size_terciles, ic_by_size, group_accounting, history_trades, history_skipped, pair_class, event_class, issuer_day_class, ic_by_type, type_accounting, arm_comparison,
        paired_difference, packet_hash, issuer_day_hash, prompt_render, issuer_day_groups, usage_by_model, spend_since, run_tokens, exclusion_counts, cost_join, sample_means,
        sample_statuses, unique_guard, append_ledger, ledger_versions, group_states, call_outcomes, running_cost, window_utilisation,
    )
}
ORACLE_SQL = {
    "size_terciles": f"WITH {FILINGS}, {_SIZES} SELECT CAST(day AS VARCHAR) AS day, cik, size, bucket FROM buckets",
    "ic_by_size": f"""WITH {_BUCKETED}, u AS (SELECT * FROM g WHERE bucket IS NOT NULL AND gn >= 10), {ic_sql('u', 'bucket, day')},
a AS (SELECT bucket, count(ic) AS days, avg(ic) AS mean_ic, stddev_samp(ic) / sqrt(count(ic)) AS error FROM daily GROUP BY bucket), n AS (SELECT bucket, count(*) AS issuer_days, median(size) AS median_size FROM u GROUP BY bucket)
SELECT bucket, days, issuer_days, round(mean_ic, 9) AS mean_ic, round(error, 9) AS error, round(mean_ic / error, 9) AS t, round(median_size, 9) AS median_size FROM a JOIN n USING (bucket)""",
    "group_accounting": f"WITH {_BUCKETED} SELECT count(*) AS total, count(*) FILTER (bucket IS NOT NULL AND gn >= 44) AS in_rows, count(*) FILTER (bucket IS NOT NULL AND gn < 44) AS dropped, count(*) FILTER (bucket IS NULL) AS ungrouped FROM g",
    "history_trades": f"WITH {_HIST} SELECT year, month, count(*) AS trades, count(DISTINCT owner) AS owners FROM h GROUP BY ALL",
    "history_skipped": f"WITH {_HIST} SELECT count(*) FILTER (traded IS NULL) AS unparseable, count(*) FILTER (traded > filed) AS future_dated FROM t",
    "pair_class": f"{_PAIRSQL} SELECT accession_no, class FROM c",
    "event_class": f"{_PAIRSQL} SELECT issuer || '|' || CAST(date_trunc('month', accepted) AS DATE) AS key, CASE WHEN count(DISTINCT class) = 1 THEN min(class) ELSE 'unclassified' END AS class FROM c GROUP BY 1",
    "issuer_day_class": f"WITH {FILINGS}, {_DAYCLASS} SELECT CAST(day AS VARCHAR) AS day, cik, class FROM dc",
    "ic_by_type": f"""WITH {_TYPED}, u AS (SELECT * FROM gg WHERE kind IS NOT NULL AND gn >= 10), {ic_sql('u', 'kind, day')},
a AS (SELECT kind, count(ic) AS days, avg(ic) AS mean_ic, stddev_samp(ic) / sqrt(count(ic)) AS error FROM daily GROUP BY kind), n AS (SELECT kind, count(*) AS issuer_days FROM u GROUP BY kind)
SELECT kind, days, issuer_days, round(mean_ic, 9) AS mean_ic, round(error, 9) AS error, round(mean_ic / error, 9) AS t FROM a JOIN n USING (kind)""",
    "type_accounting": f"""WITH {_TYPED} SELECT count(*) AS total, count(*) FILTER (kind IS NOT NULL AND gn >= 10) AS in_rows, count(*) FILTER (kind IS NOT NULL AND gn < 10) AS dropped, count(*) FILTER (kind IS NULL) AS ungrouped,
count(*) FILTER (class = 'mixed') AS mixed, count(*) FILTER (kind IS NULL) - count(*) FILTER (class = 'mixed') AS unclassified FROM gg""",
    "arm_comparison": f"{_CMP} SELECT count(*) AS total, count(*) FILTER (NOT whole) AS dropped, count(*) FILTER (whole AND n < 10) AS unranked, count(*) FILTER (whole AND n >= 10) AS compared FROM w",
    "paired_difference": f"""{_CMP}, ub AS (SELECT day, base AS forecast, abnormal_return FROM w WHERE whole AND n >= 10), uo AS (SELECT day, other AS forecast, abnormal_return FROM w WHERE whole AND n >= 10),
{ic_sql('ub', 'day', 'ib')}, {ic_sql('uo', 'day', 'io')}
SELECT CAST(ib.day AS VARCHAR) AS day, ib.n, round(ib.ic, 9) AS base_ic, round(io.ic, 9) AS other_ic, round(ib.ic - io.ic, 9) AS difference FROM ib JOIN io USING (day)""",
    "packet_hash": r"""WITH c AS (SELECT doc_id, '{"event_id":' || doc_id || ',"lang":"' || lang || '","price":"' ||
  regexp_replace(regexp_replace(CAST(CAST(n_chars / 4.0::DOUBLE AS DECIMAL(18, 2)) AS VARCHAR), '(\.\d*?)0+$', '\1'), '\.$', '') || '","session":"2024-01-05","ticker":null}' AS canonical FROM documents)
SELECT doc_id, canonical, sha256(canonical) AS content_hash FROM c""",
    "issuer_day_hash": "WITH h AS (SELECT DISTINCT conv_id, sha256(text) AS h FROM conversations) SELECT conv_id, sha256(string_agg(h, chr(10) ORDER BY h)) AS group_hash, count(*) AS packets FROM h GROUP BY conv_id",
    "prompt_render": r"""SELECT conv_id, string_agg(turn || ' | ' || role || ' | ' || replace(trim(regexp_replace(nfc_normalize(text), '[\s\x0B\x1C-\x1F\x{85}\p{Z}]+', ' ', 'g')), '|', '/'), chr(10) ORDER BY turn) AS prompt FROM conversations GROUP BY conv_id""",
    "issuer_day_groups": f"""WITH {FILINGS}, l AS (SELECT *, (as_of AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York' AS local FROM filings)
SELECT cik, CAST(CAST(local AS DATE) AS VARCHAR) AS day, CAST(local AS TIME) < TIME '09:30:00' AS before_open, count(*) AS events, arg_min(accession_no, (as_of, accession_no)) AS first_event FROM l GROUP BY ALL""",
    "usage_by_model": f"{_USAGE} SELECT model, count(*) AS calls, sum(input)::BIGINT AS input, sum(cache_read)::BIGINT AS cache_read, round(sum(cost), 6) AS cost FROM u GROUP BY model",
    "spend_since": f"{_USAGE} SELECT round(sum(cost), 6) AS spent FROM u WHERE as_of >= TIMESTAMP '2024-01-20'",
    "run_tokens": f"{_USAGE} SELECT run_id, sum(input + output + cache_read)::BIGINT AS tokens FROM u GROUP BY run_id",
    "exclusion_counts": "SELECT 'reason ' || (user_id % 4) AS reason, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1",
    "cost_join": f"{_USAGE} SELECT run_id % 500 AS issuer_day_hash, round(sum(cost), 6) AS cost FROM u WHERE run_id % 500 IN (SELECT accession_no % 500 FROM filings WHERE accession_no % 3 = 0) GROUP BY 1",
    "sample_means": f"WITH {FILINGS}, s AS (SELECT accession_no // 3 AS g, forecast * 1.01::DOUBLE AS p, {_status('1.01::DOUBLE', 'false')} AS status FROM filings) SELECT g AS \"group\", round(avg(p), 9) AS forecast FROM s WHERE status = 'ok' GROUP BY g HAVING count(*) = 3",
    "sample_statuses": f"WITH {FILINGS} SELECT {_status('1.1::DOUBLE', 'accession_no % 23 = 0')} AS status, count(*) AS n FROM filings GROUP BY 1",
    "unique_guard": f"""WITH {FILINGS}, e AS (SELECT cik, day FROM filings WHERE accession_no % 2 = 0), r AS (SELECT cik, day FROM filings WHERE accession_no % 2 = 1)
SELECT cik, CAST(day AS VARCHAR) AS day FROM (SELECT cik, day FROM r GROUP BY ALL HAVING count(*) > 1 UNION SELECT r.cik, r.day FROM r SEMI JOIN e USING (cik, day))""",
    "ledger_versions": f"""WITH {FILINGS} SELECT transaction_code AS model, CASE WHEN accession_no % 3 > 0 THEN cik::VARCHAR END AS issuer_day_hash, count(*) AS calls,
  sum(coalesce(shares, 0) + 1 + remaining_shares + CASE WHEN accession_no % 3 = 2 THEN 3 * coalesce(shares, 0) ELSE 0 END)::BIGINT AS tokens, sum(value_usd::DECIMAL(12, 6))::DOUBLE AS cost
FROM filings GROUP BY ALL""",
    "call_outcomes": """WITH t AS (SELECT *, length(text) AS n, max(turn) OVER (PARTITION BY conv_id) AS last FROM conversations),
s AS (SELECT conv_id AS call, sum(n) % 17 = 0 AS broken, bool_or(turn = 0 AND n % 29 = 0) AS tooled, bool_or(turn = 0) AS started, bool_or(role = 'user' AND n % 37 = 0) AS rejected,
  max_by(n / 1000, turn) FILTER (role = 'user') AS used, max(n) FILTER (turn = last AND turn > 0) AS r FROM t GROUP BY 1)
SELECT call, CASE WHEN r IS NULL OR NOT started THEN 'error' WHEN r % 11 = 0 OR broken THEN CASE WHEN rejected THEN 'rate_limited' ELSE 'error' END WHEN r % 13 = 0 THEN 'refused'
  WHEN r <= 600 THEN 'ok' WHEN rejected THEN 'rate_limited' ELSE 'invalid_output' END AS status, CASE WHEN tooled THEN 'tools' ELSE '' END AS problems,
  CASE WHEN r % 11 <> 0 AND NOT broken AND r % 13 <> 0 AND r <= 600 THEN round(r / 1500, 9) END AS estimate, round(used, 9) AS used FROM s""",
    "append_ledger": "SELECT user_id AS cik, count(*) AS n FROM events GROUP BY 1",
    "group_states": f"""WITH {FILINGS}, m AS (SELECT cik, (day < DATE '2024-01-10' OR cik % 10 = 0) AND cik % 10 <> 1 AS known FROM filings), g AS (SELECT cik, CASE WHEN bool_and(known) THEN 'done' WHEN bool_or(known) THEN 'changed' ELSE 'new' END AS state FROM m GROUP BY cik)
SELECT state, count(*) AS n FROM g GROUP BY state""",
    "running_cost": f"WITH {FILINGS} SELECT accession_no, max(value_usd) OVER (PARTITION BY cik ORDER BY as_of, accession_no ROWS UNBOUNDED PRECEDING) AS largest FROM filings",
    "window_utilisation": f"WITH {FILINGS} SELECT transaction_code, arg_max(value_usd, (as_of, accession_no)) AS last_value FROM filings GROUP BY 1",
}
