"""Queries over filings: screens, dedupe, symbols, sectors, calendar, times."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import sectors, text, times
from ..operators import calendar, events
from .roles import FILINGS, filings, read

SCREEN_FLOOR = 250.0
YEARS = range(1995, 2028)


def insider_screen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.insider_screen(filings(spark, sf_dir), SCREEN_FLOOR).select("accession_no", "cik", "transaction_code", "value_usd")


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as transaction rows with text cells, some of them spoilt in a fixed way."""
    li = read(spark, sf_dir, "lineitem")
    k = (F.col("l_orderkey") * 7 + F.col("l_linenumber")) % 41
    shares = F.when(k == 0, "1,000").when(k == 1, "").when(k == 2, "nan").when(k == 6, "\t\u2028").when(k == 7, F.concat(F.lit("\n"), F.col("l_quantity").cast("long").cast("string"), F.lit("\u00a0\t"))).otherwise(F.col("l_quantity").cast("long").cast("string"))
    price = F.when(k == 3, "$5").when(k == 4, "  ").when(k == 5, "N/A").when(k == 8, "\n\x85").otherwise(F.col("l_suppkey").cast("string"))
    return li.select(F.col("l_orderkey").alias("filing"), "l_linenumber", shares.alias("shares"), price.alias("price"))


def present_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = _cells(spark, sf_dir)
    kept = events.present_rows(cells.withColumn("shares", F.when(F.col("filing") % 2 == 0, F.col("shares"))), ["shares"])
    return kept.agg(F.count(F.lit(1)).alias("rows"), F.sum("l_linenumber").cast("long").alias("lines"))


def rejected_filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.classify_cells(_cells(spark, sf_dir), "filing", ["shares"], ["price"]).filter("rejected").select("filing")


def reject_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = events.classify_cells(_cells(spark, sf_dir), "filing", ["shares"], ["price"])
    return judged.agg(
        F.count_if("rejected").alias("rejected"), F.count(F.lit(1)).alias("attempted"), F.round(F.count_if("rejected") / F.count(F.lit(1)), 9).alias("rate"),
        (F.count_if("rejected") / F.count(F.lit(1)) > 0.05).alias("broken"),
    )


def filing_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return events.dedupe_first(rows, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey"]).select("l_orderkey", F.col("l_partkey"), "l_suppkey")


def transaction_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag", "l_linestatus", (F.col("l_linenumber") % 2).alias("odd"))
    kept = events.dedupe_transactions(rows, "l_orderkey", ["l_returnflag", "l_linestatus", "odd"])
    return kept.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("transactions"))


def owner_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.lpad(F.col("l_suppkey").cast("string"), 10, "0")).alias("owners"))
    owners = events.owner_set(F.col("owners"))
    return rows.select("l_orderkey", F.array_join(owners.cast("array<string>"), ",").alias("owners"), F.size(owners).cast("long").alias("n"))


_ITEMS = ("Item 5.02(b)", "ITEM 4.01", " item4.02(a)", "Item 9.01", "Item 8.01", "5.02")


def trigger_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = F.array(*[F.lit(i) for i in _ITEMS])
    docs = read(spark, sf_dir, "documents").select(
        "doc_id", F.slice(labels, (F.col("doc_id") % 5 + 1).cast("int"), (F.col("n_chars") % 3 + 1).cast("int")).alias("items"), F.lit(None).cast("string").alias("text")
    )
    return events.redflag_events(docs).select("doc_id", F.array_join("item_codes", ",").alias("codes"))


_TITLES = (
    "Common Stock, par value $0.01", "Class A  Common Stock and associated Preferred Stock Purchase Rights", "Warrants to purchase Common Stock",
    "Common Units representing limited partner interests", "Units, each consisting of one ordinary share", "6.5% Senior Notes due 2030",
    "Ordinary Shares", "Depositary Shares",
)
_SYMBOLS = ("abc", "BRK.B", "n/a", "NONE", "ZWST", "toolong", "X", "GOOD1", "\tq\n", "\u2003none\u2028", "\u00a0tab\x1f")


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part")

    def pick(values: tuple[str, ...], by) -> F.Column:
        return F.element_at(F.array(*[F.lit(v) for v in values]), (by % len(values) + 1).cast("int"))

    return p.select("p_partkey", (F.col("p_partkey") % 500).alias("filing"), pick(_TITLES, F.col("p_size")).alias("title"), pick(_SYMBOLS, F.col("p_partkey")).alias("symbol"))


def security_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = text.title_class(F.col("title"))
    return _parts(spark, sf_dir).select("p_partkey", text.tradeable_symbol(F.col("symbol")).alias("symbol"), F.coalesce(kind == "common", F.lit(False)).alias("common"), F.coalesce(kind == "other", F.lit(False)).alias("other"))


def ticker_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _parts(spark, sf_dir).select(F.col("filing").alias("accession_no"), "symbol", "title", F.col("p_partkey").alias("seq"), (F.col("p_partkey") % 3).alias("entity_cik"), F.lit(1).cast("long").alias("cik"))
    return events.choose_ticker(rows)


def ticker_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    issuers = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("cik"), F.when(F.col("c_custkey") % 3 > 0, F.concat(F.lit("C"), F.col("c_nationkey").cast("string"))).alias("current"))
    rows = filings(spark, sf_dir).select("accession_no", (F.col("cik") * 13).alias("cik"), F.when(F.col("accession_no") % 10 == 0, "ZZ").alias("ticker"), F.lit(None).cast("string").alias("ticker_source"))
    kept, gone = events.complete_tickers(rows, issuers)
    return kept.groupBy(F.col("ticker_source").alias("outcome")).agg(F.count(F.lit(1)).alias("n")).unionByName(gone.groupBy(F.col("reason").alias("outcome")).agg(F.count(F.lit(1)).alias("n")))


def sic_sector(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.when(F.col("p_partkey") % 50 == 0, "n/a").when(F.col("p_partkey") % 7 == 0, F.lpad(F.col("p_partkey").cast("string"), 4, "0")).otherwise((F.col("p_size") * 173 % 9000).cast("string"))
    return read(spark, sf_dir, "part").select("p_partkey", sectors.sector_fund(code).alias("fund"))


def _calendar(spark: SparkSession) -> DataFrame:
    return calendar.trading_calendar(spark, "2026-01-01", "2027-12-31")


def _shifted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filings of 2024 moved to 2026, a covered year."""
    return filings(spark, sf_dir).select("accession_no", F.date_add("day", 731).alias("day"))


def _filed(spark: SparkSession, sf_dir: str, days: DataFrame) -> DataFrame:
    """days with the number of filings on each."""
    filed = _shifted(spark, sf_dir).groupBy("day").agg(F.count(F.lit(1)).alias("n"))
    return days.join(filed, "day", "left").withColumn("filings", F.coalesce("n", F.lit(0))).withColumn("day", F.col("day").cast("string")).drop("n")


def trading_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _filed(spark, sf_dir, _calendar(spark).filter("trading").select("day", "idx"))


def sampled_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _filed(spark, sf_dir, calendar.sampled_days(_calendar(spark), 7))


def missing_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions between the first and the last filing day on which no open-market purchase of over 490 was filed."""
    rows = filings(spark, sf_dir).withColumn("day", F.date_add("day", 731))
    span = rows.agg(F.min("day").cast("string"), F.max("day").cast("string")).first()
    built = rows.filter("transaction_code = 'P' AND value_usd > 490").select("day")
    return calendar.missing_days(calendar.trading_calendar(spark, *span), built).select(F.col("day").cast("string").alias("day"))


def sessions_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = _shifted(spark, sf_dir).select("day").distinct()
    return calendar.sessions_after(days, _calendar(spark), 3).select(F.col("day").cast("string").alias("day"), F.col("session").cast("string").alias("session"))


def window_close(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = calendar.window_close(_shifted(spark, sf_dir), _calendar(spark), 5)
    return days.groupBy(F.col("closes_on").cast("string").alias("closes_on")).agg(F.count(F.lit(1)).alias("events"))


def ripe_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = calendar.window_close(_shifted(spark, sf_dir), _calendar(spark), 5)
    return days.filter(F.col("closes_on") < F.to_date(F.lit("2026-01-27"))).agg(F.count(F.lit(1)).alias("ripe"), F.max(F.col("closes_on").cast("string")).alias("last_close"))


def held_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = calendar.window_close(_shifted(spark, sf_dir), _calendar(spark), 5)
    held = days.groupBy("day").agg(F.max("closes_on").alias("closes_on")).filter(F.col("closes_on") >= F.to_date(F.lit("2026-01-27")))
    return held.select(F.col("day").cast("string").alias("day"), F.col("closes_on").cast("string").alias("closes_on"))


def acceptance_utc(spark: SparkSession, sf_dir: str) -> DataFrame:
    spread = F.col("as_of") + F.make_dt_interval((F.col("accession_no") % 270).cast("int"))
    at = times.acceptance_utc(spread)
    local = times.entry_key(at)
    return filings(spark, sf_dir).select("accession_no", F.unix_timestamp(at).alias("accepted"), times.eastern_date(at).cast("string").alias("eastern"), local[1].alias("before_open"))


def session_close(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.date_add("day", (F.col("accession_no") % 365).cast("int"))
    return filings(spark, sf_dir).select(day.cast("string").alias("session"), F.unix_timestamp(times.session_close(day)).alias("closes")).distinct()


def usable_news(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import prices

    news = read(spark, sf_dir, "documents").select("doc_id", F.date_add(F.to_date(F.lit("2024-01-01")), (F.col("doc_id") % 30).cast("int")).alias("created_at"), F.date_add(F.to_date(F.lit("2024-01-01")), (F.col("doc_id") % 30 + F.col("n_chars") % 4).cast("int")).alias("updated_at"))
    days = filings(spark, sf_dir).select("day").distinct()
    return prices.usable_counts(news, days).select(F.col("day").cast("string").alias("day"), "articles")


# Every white space of Unicode, for the other engine's trim().
WHITE_SQL = "(" + " || ".join(f"chr({c})" for c in (*range(9, 14), *range(28, 33), 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288)) + ")"


def strip_sql(column: str) -> str:
    return f"trim({column}, {WHITE_SQL})"


_LI = """cells AS (SELECT l_orderkey AS filing, l_linenumber, (l_orderkey * 7 + l_linenumber) % 41 AS k, l_quantity, l_suppkey FROM lineitem),
t AS (SELECT filing, l_linenumber, CASE k WHEN 0 THEN '1,000' WHEN 1 THEN '' WHEN 2 THEN 'nan' WHEN 6 THEN chr(9) || chr(8232) WHEN 7 THEN chr(10) || CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) || chr(160) || chr(9) ELSE CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) END AS shares,
  CASE k WHEN 3 THEN '$5' WHEN 4 THEN '  ' WHEN 5 THEN 'N/A' WHEN 8 THEN chr(10) || chr(133) ELSE CAST(l_suppkey AS VARCHAR) END AS price FROM cells)"""
_BLANK = "('', 'nan', 'none', 'null', '<na>', 'nat')"
_REJECT = f"""{_LI}, j AS (SELECT filing, bool_or(lower({strip_sql('shares')}) IN {_BLANK} OR try_cast({strip_sql('shares')} AS DECIMAL(38, 18)) IS NULL
  OR (lower({strip_sql('price')}) NOT IN {_BLANK} AND try_cast({strip_sql('price')} AS DECIMAL(38, 18)) IS NULL)) AS rejected FROM t GROUP BY filing)"""
_SQL_ITEMS = "[" + ", ".join(f"'{i}'" for i in _ITEMS) + "]"


def _list(values: tuple[str, ...]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


_PARTS = f"parts AS (SELECT p_partkey, p_partkey % 500 AS filing, {_list(_TITLES)}[p_size % 8 + 1] AS title, {_list(_SYMBOLS)}[p_partkey % {len(_SYMBOLS)} + 1] AS symbol FROM part)"
# The other engine has no look-behind: common units are taken out of the text before units are looked for.
_HEAD = (
    "regexp_replace(trim(regexp_replace(title, '\\s+', ' ', 'g')), "
    "'(?i)\\s*\\(?\\s*\\b(?:and|together with|including)\\s+(?:the\\s+)?(?:associated|attached|related)\\b[^()]*\\bpurchase\\s+rights?\\b\\)?\\s*$', '')"
)
_OTHER = f"regexp_matches(regexp_replace({_HEAD}, '(?i)common units?', '', 'g'), '(?i)\\bwarrants?\\b|\\brights?\\b|\\bpreferred\\b|\\bpreference\\b|\\bdepositary\\b|\\bnotes?\\b|\\bdebentures?\\b|\\bbonds?\\b|\\bunits?\\b')"
_COMMON = f"(regexp_matches({_HEAD}, '(?i)\\bcommon\\b|\\bordinary shares?\\b|\\bcapital stock\\b') AND NOT {_OTHER})"
_S = f"upper({strip_sql('symbol')})"
_SYMBOL = f"CASE WHEN regexp_full_match({_S}, '[A-Z]{{1,5}}(\\.[A-Z]{{1,2}})?') AND {_S} NOT IN ('NULL', 'NONE', 'NAN', 'NA', 'UNKNOWN', 'ERROR', 'TBD') THEN {_S} END"
_HOLIDAYS = ", ".join(f"DATE '{h}'" for h in calendar.HOLIDAYS)
_CAL = f"""cal AS (SELECT CAST(d AS DATE) AS day, isodow(d) < 6 AND CAST(d AS DATE) NOT IN ({_HOLIDAYS}) AS trading FROM generate_series(DATE '2026-01-01', DATE '2027-12-31', INTERVAL 1 DAY) g(d)),
sess AS (SELECT day, row_number() OVER (ORDER BY day) AS idx FROM cal WHERE trading)"""
_MOVED = f"{FILINGS}, moved AS (SELECT accession_no, day + 731 AS day FROM filings), days AS (SELECT DISTINCT day FROM moved)"


def _nth(n: int) -> str:
    return f"nth AS (SELECT d.day, (SELECT s.day FROM sess s WHERE s.day > d.day ORDER BY s.day LIMIT 1 OFFSET {n - 1}) AS session FROM days d)"


_CLOSE = f"WITH {_CAL}, {_MOVED}, {_nth(6)}, closes AS (SELECT m.accession_no, m.day, n.session AS closes_on FROM moved m JOIN nth n USING (day))"
_SIC_ROWS = ", ".join(f"({lo}, {hi}, '{fund}', {k})" for k, (lo, hi, fund) in enumerate(sectors.MAJOR_GROUPS))
_SIC_FULL = ", ".join(f"({c}, '{fund}')" for c, fund in sectors.FULL_CODES)

QUERIES = {
    f.__name__: f
    for f in (
        insider_screen, present_rows, rejected_filings, reject_rate, filing_dedupe, transaction_dedupe, owner_sets, trigger_items, security_class, ticker_choice,
        ticker_completion, sic_sector, trading_calendar, sampled_days, missing_days, sessions_after, window_close, ripe_events, held_days, acceptance_utc, session_close, usable_news,
    )
}
ORACLE_SQL = {
    "insider_screen": f"WITH {FILINGS} SELECT accession_no, cik, transaction_code, value_usd FROM filings WHERE NOT is_plan AND transaction_code IN ('P', 'S') AND value_usd >= 250",
    "present_rows": f"WITH {_LI} SELECT count(*) AS rows, sum(l_linenumber)::BIGINT AS lines FROM t WHERE filing % 2 = 0 AND lower({strip_sql('shares')}) NOT IN {_BLANK}",
    "rejected_filings": f"WITH {_REJECT} SELECT filing FROM j WHERE rejected",
    "reject_rate": f"WITH {_REJECT} SELECT count(*) FILTER (rejected) AS rejected, count(*) AS attempted, round(count(*) FILTER (rejected) / count(*)::DOUBLE, 9) AS rate, count(*) FILTER (rejected) / count(*)::DOUBLE > 0.05 AS broken FROM j",
    "filing_dedupe": "SELECT l_orderkey, l_partkey, l_suppkey FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) = 1",
    "transaction_dedupe": "SELECT l_orderkey, count(*) AS transactions FROM (SELECT DISTINCT l_orderkey, l_returnflag, l_linestatus, l_linenumber % 2 AS odd FROM lineitem) GROUP BY l_orderkey",
    "owner_sets": "SELECT l_orderkey, string_agg(CAST(l_suppkey AS VARCHAR), ',' ORDER BY l_suppkey) AS owners, count(*) AS n FROM (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) GROUP BY l_orderkey",
    "trigger_items": f"""WITH i AS (SELECT doc_id, unnest({_SQL_ITEMS}[doc_id % 5 + 1 : doc_id % 5 + n_chars % 3 + 1]) AS item FROM documents),
c AS (SELECT DISTINCT doc_id, regexp_extract(item, '(?i)^\\s*item\\s*(\\d+\\.\\d+)', 1) AS code FROM i)
SELECT doc_id, string_agg(code, ',' ORDER BY code) AS codes FROM c WHERE code IN ('4.01', '4.02', '5.02') GROUP BY doc_id""",
    "security_class": f"WITH {_PARTS} SELECT p_partkey, {_SYMBOL} AS symbol, {_COMMON} AS common, {_OTHER} AS other FROM parts",
    "ticker_choice": f"""WITH {_PARTS}, c AS (SELECT filing, p_partkey AS seq, {_SYMBOL} AS s, {_COMMON} AS common, {_OTHER} AS other FROM parts WHERE p_partkey % 3 = 1),
p AS (SELECT filing, min_by(s, seq) FILTER (common) AS first_common, count(*) AS n, min(s) AS single, bool_or(other) AS other FROM c WHERE s IS NOT NULL GROUP BY filing),
q AS (SELECT filing AS accession_no, coalesce(first_common, CASE WHEN n = 1 AND NOT other THEN single END) AS ticker FROM p) SELECT * FROM q WHERE ticker IS NOT NULL""",
    "ticker_completion": f"""WITH {FILINGS}, r AS (SELECT f.accession_no, CASE WHEN f.accession_no % 10 = 0 THEN 'ZZ' END AS ticker, c.c_custkey, c.c_custkey % 3 > 0 AS listed FROM filings f LEFT JOIN customer c ON c.c_custkey = f.cik * 13)
SELECT CASE WHEN ticker IS NOT NULL THEN 'filing' WHEN listed THEN 'current' WHEN c_custkey IS NULL THEN 'issuer not found' ELSE 'issuer has no listed symbol' END AS outcome, count(*) AS n FROM r GROUP BY 1""",
    "sic_sector": f"""WITH g(lo, hi, fund, k) AS (VALUES {_SIC_ROWS}), f(code, fund) AS (VALUES {_SIC_FULL}),
p AS (SELECT p_partkey, CASE WHEN p_partkey % 50 = 0 THEN NULL WHEN p_partkey % 7 = 0 THEN CAST(left(lpad(CAST(p_partkey AS VARCHAR), 4, '0'), 4) AS INTEGER) ELSE p_size * 173 % 9000 END AS code FROM part)
SELECT p_partkey, coalesce((SELECT fund FROM f WHERE f.code = p.code), (SELECT max_by(fund, k) FROM g WHERE p.code // 100 BETWEEN lo AND hi), 'SPY') AS fund FROM p""",
    "trading_calendar": f"WITH {_CAL}, {_MOVED} SELECT CAST(s.day AS VARCHAR) AS day, idx, count(m.accession_no) AS filings FROM sess s LEFT JOIN moved m ON m.day = s.day GROUP BY ALL",
    "sampled_days": f"WITH {_CAL}, {_MOVED} SELECT CAST(s.day AS VARCHAR) AS day, count(m.accession_no) AS filings FROM sess s LEFT JOIN moved m ON m.day = s.day WHERE (idx - 1) % 7 = 0 GROUP BY ALL",
    "missing_days": f"""WITH {_CAL}, {_MOVED} SELECT CAST(day AS VARCHAR) AS day FROM sess WHERE day BETWEEN (SELECT min(day) FROM moved) AND (SELECT max(day) FROM moved)
  AND day NOT IN (SELECT day + 731 FROM filings WHERE transaction_code = 'P' AND value_usd > 490)""",
    "sessions_after": f"WITH {_CAL}, {_MOVED}, {_nth(3)} SELECT CAST(day AS VARCHAR) AS day, CAST(session AS VARCHAR) AS session FROM nth",
    "window_close": f"{_CLOSE} SELECT CAST(closes_on AS VARCHAR) AS closes_on, count(*) AS events FROM closes GROUP BY 1",
    "ripe_events": f"{_CLOSE} SELECT count(*) AS ripe, CAST(max(closes_on) AS VARCHAR) AS last_close FROM closes WHERE closes_on < DATE '2026-01-27'",
    "held_days": f"{_CLOSE} SELECT CAST(day AS VARCHAR) AS day, CAST(max(closes_on) AS VARCHAR) AS closes_on FROM closes GROUP BY day HAVING max(closes_on) >= DATE '2026-01-27'",
    "acceptance_utc": f"""WITH {FILINGS}, s AS (SELECT accession_no, (as_of + to_days(CAST(accession_no % 270 AS INTEGER))) AT TIME ZONE 'America/New_York' AS t FROM filings)
SELECT accession_no, CAST(floor(epoch(t)) AS BIGINT) AS accepted, CAST(CAST(t AT TIME ZONE 'America/New_York' AS DATE) AS VARCHAR) AS eastern, CAST(t AT TIME ZONE 'America/New_York' AS TIME) < TIME '09:30:00' AS before_open FROM s""",
    "session_close": f"""WITH {FILINGS}, s AS (SELECT DISTINCT day + CAST(accession_no % 365 AS INTEGER) AS d FROM filings)
SELECT CAST(d AS VARCHAR) AS session, CAST(epoch((d + INTERVAL 16 HOUR) AT TIME ZONE 'America/New_York') AS BIGINT) AS closes FROM s""",
    "usable_news": f"""WITH {FILINGS}, n AS (SELECT DATE '2024-01-01' + CAST(doc_id % 30 AS INTEGER) AS c, DATE '2024-01-01' + CAST(doc_id % 30 + n_chars % 4 AS INTEGER) AS u FROM documents)
SELECT CAST(day AS VARCHAR) AS day, count(*) AS articles FROM n JOIN (SELECT DISTINCT day FROM filings) d ON n.c < d.day AND n.u <= d.day GROUP BY 1""",
}
