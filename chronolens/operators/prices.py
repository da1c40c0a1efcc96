"""Daily bars, point-in-time joins to them, and labels.

Bars are stamped at Eastern midnight of their session, so "the first bar after an instant" is "the first session after
the instant's date". Each session therefore owns the days since the one before it; both as-of joins become equi-joins
on (symbol, day) without fan-out, whatever gaps a halt leaves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

PRICE = "decimal(18,6)"
BAR_JSON = "map<string,array<struct<t:string,o:string,h:string,l:string,c:string,v:string>>>"


def parse_bars(raw: DataFrame, column: str = "bars") -> DataFrame:
    """symbol, ts, open, high, low, close, volume from a JSON map of symbol to bars; numbers go through text, never through doubles."""
    kept = raw.select(F.explode(F.from_json(column, BAR_JSON, {"primitivesAsString": "true"})).alias("symbol", "b"))
    one = kept.select("symbol", F.explode("b").alias("b"))
    return one.select("symbol", F.to_timestamp("b.t").alias("ts"), *[F.col(f"b.{k}").try_cast(PRICE).alias(n) for k, n in zip("ohlcv", ("open", "high", "low", "close", "volume"), strict=True)])


def numbered(bars: DataFrame) -> DataFrame:
    """bars with idx, the position of a session in its symbol's series."""
    return bars.withColumn("idx", F.row_number().over(Window.partitionBy("symbol").orderBy("session")))


def paired(bars: DataFrame, benchmarks: DataFrame) -> DataFrame:
    """Sessions that both a symbol and its benchmark have, numbered after pairing; benchmarks: symbol, benchmark."""
    other = bars.select(F.col("symbol").alias("benchmark"), "session", F.col("open").alias("benchmark_open"), F.col("close").alias("benchmark_close"))
    return numbered(bars.join(benchmarks, "symbol").join(other, ["benchmark", "session"]))


def next_session(rows: DataFrame, series: DataFrame, columns: list[str], key: str = "symbol", day: str = "day") -> DataFrame:
    """rows (key, day) left joined to columns of the first session strictly after the day.

    Each session owns the days since the one before it; days before a series begins count as the last one before that.
    """
    before = F.coalesce(F.lag("session").over(Window.partitionBy("symbol").orderBy("session")), F.date_sub("session", 1))
    owned = series.withColumn("_from", before).select(F.col("symbol").alias(key), *columns, F.explode(F.sequence("_from", F.date_sub("session", 1))).alias("_day"))
    start = series.groupBy(F.col("symbol").alias(key)).agg(F.date_sub(F.min("session"), 1).alias("_start"))
    return rows.join(start, key, "left").withColumn("_day", F.greatest(day, "_start")).join(owned, [key, "_day"], "left").drop("_day", "_start")


def last_closed(rows: DataFrame, series: DataFrame, columns: list[str], key: str = "symbol", day: str = "day") -> DataFrame:
    """rows (key, day) left joined to columns of the last session on or before the day; days after a series ends count as its last."""
    after = F.coalesce(F.lead("session").over(Window.partitionBy("symbol").orderBy("session")), F.date_add("session", 1))
    owned = series.withColumn("_to", F.date_sub(after, 1)).select(F.col("symbol").alias(key), *columns, F.explode(F.sequence("session", "_to")).alias("_day"))
    end = series.groupBy(F.col("symbol").alias(key)).agg(F.max("session").alias("_end"))
    return rows.join(end, key, "left").withColumn("_day", F.least(day, "_end")).join(owned, [key, "_day"], "left").drop("_day", "_end")


def valid_price(c: Column) -> Column:
    number = c.cast("double")
    return c.isNotNull() & ~F.isnan(number) & (number > 0) & (number < float("inf"))


def excess_return(entry: Column, exit_: Column, base_entry: Column, base_exit: Column) -> Column:
    """Simple return over the benchmark's, rounded half to even at 12 places; prices as decimals of six places."""
    e, x, be, bx = (c.cast(PRICE) for c in (entry, exit_, base_entry, base_exit))
    return F.bround((x - e) / e - (bx - be) / be, 12)


def label_events(events: DataFrame, bars: DataFrame, benchmarks: DataFrame, horizon: int, day: str = "day") -> DataFrame:
    """events (symbol, day) with entry and exit of the paired series, abnormal_return, and reason where there is none.

    Horizon H needs H + 1 paired sessions after the event; the exit is the close at position H from the entry. Raw
    series are counted before pairing, the issuer's first, so the reason names the side that is short.
    """
    later = Window.partitionBy("symbol").orderBy("session")
    left = F.count(F.lit(1)).over(later.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    own = bars.select("symbol", "session", left.alias("issuer_sessions"))
    base = own.withColumnRenamed("issuer_sessions", "benchmark_sessions")
    pair = paired(bars, benchmarks).withColumns({
        "entry_session": F.col("session"), "entry_price": F.col("open"), "benchmark_entry": F.col("benchmark_open"),
        "exit_session": F.lead("session", horizon).over(later), "exit_price": F.lead("close", horizon).over(later), "benchmark_exit": F.lead("benchmark_close", horizon).over(later),
    })
    rows = next_session(events.join(benchmarks, "symbol", "left"), own, ["issuer_sessions"], day=day)
    rows = next_session(rows, base, ["benchmark_sessions"], key="benchmark", day=day)
    rows = next_session(rows, pair, ["entry_session", "entry_price", "benchmark_entry", "exit_session", "exit_price", "benchmark_exit"], day=day)
    prices = ["entry_price", "exit_price", "benchmark_entry", "benchmark_exit"]
    sound = valid_price(F.col(prices[0]))
    for p in prices[1:]:
        sound = sound & valid_price(F.col(p))
    need = horizon + 1
    reason = (
        F.when(F.col("benchmark").isNull(), "no benchmark")
        .when(F.coalesce("issuer_sessions", F.lit(0)) < need, "issuer series too short")
        .when(F.coalesce("benchmark_sessions", F.lit(0)) < need, "benchmark series too short")
        .when(F.col("exit_session").isNull(), "too few common sessions")
        .when(~sound, "unusable price")
    )
    rows = rows.withColumn("reason", reason)
    value = excess_return(*[F.col(p) for p in prices])
    return rows.withColumn("abnormal_return", F.when(F.col("reason").isNull(), value)).drop("issuer_sessions", "benchmark_sessions")


def session_statistics(bars: DataFrame, trailing: int = 21, volumes: int = 63, year: int = 252) -> DataFrame:
    """symbol, session, idx with trailing return, realised volatility and volume mid-rank as of each session's close.

    Computed once a session instead of once an event. NULL where the series is too short. Both windows need
    trailing + 1 and volumes sessions; the mid-rank compares the last volume with the volumes - 1 before it.
    """
    series = Window.partitionBy("symbol").orderBy("session")
    base = numbered(bars).withColumn("r", F.ln(F.col("close") / F.lag("close").over(series)))
    earlier = F.collect_list("volume").over(series.rowsBetween(-(volumes - 1), -1))
    below, ties = F.size(F.filter("earlier", lambda v: v < F.col("volume"))), F.size(F.filter("earlier", lambda v: v == F.col("volume")))
    base = base.withColumns({
        "earlier": earlier,
        "start": F.lag("close", trailing).over(series),
        "deviation": F.stddev_samp("r").over(series.rowsBetween(-(trailing - 1), 0)),
    })
    return base.select(
        "symbol", "session", "idx", "close", "volume",
        F.when(F.col("start").isNotNull(), F.col("close") / F.col("start") - 1).alias("trailing_return"),
        F.when(F.col("start").isNotNull(), F.col("deviation") * F.sqrt(F.lit(float(year)))).alias("realised_volatility"),
        F.when(F.size("earlier") == volumes - 1, (below + ties / 2) / F.lit(volumes - 1)).alias("volume_midrank"),
    )


def median_dollar_volume(bars: DataFrame, sessions: int = 20) -> DataFrame:
    """symbol, session, dollar_volume: median of close x volume over the last `sessions` sessions, NULL where there are fewer."""
    series = Window.partitionBy("symbol").orderBy("session").rowsBetween(-(sessions - 1), 0)
    traded = F.array_sort(F.collect_list(F.col("close") * F.col("volume")).over(series))
    half = sessions // 2
    middle = F.get(traded, F.lit(half)) if sessions % 2 else (F.get(traded, F.lit(half - 1)) + F.get(traded, F.lit(half))) / 2
    return bars.select("symbol", "session", F.when(F.size(traded) == sessions, middle).alias("dollar_volume"))


def window_plan(events: DataFrame, start: str, end: str) -> DataFrame:
    """First and last day needed of each symbol."""
    return events.groupBy("symbol").agg(F.min(start).alias("start"), F.max(end).alias("end"), F.count(F.lit(1)).alias("events"))


def day_window(events: DataFrame, start: str, end: str, today: Column) -> DataFrame:
    """One range for all, ending before today."""
    return events.agg(F.min(start).alias("start"), F.least(F.max(end), F.date_sub(today, 1)).alias("end"))


def usable_news(news: DataFrame, as_of: Column) -> DataFrame:
    """Articles created before, and last updated not after, the instant."""
    return news.filter((F.col("created_at") < as_of) & (F.col("updated_at") <= as_of))


def usable_counts(news: DataFrame, days: DataFrame) -> DataFrame:
    """day, articles: how many articles (created_at, updated_at as days) are usable at the start of each of the days; days without any are left out.

    An article counts from the day after its creation or, if later, the day of its last update on: a running count over days.
    """
    fresh = news.groupBy(F.greatest(F.date_add("created_at", 1), F.col("updated_at")).alias("day")).agg(F.count(F.lit(1)).alias("n"))
    marked = fresh.withColumn("asked", F.lit(False)).unionByName(days.select("day", F.lit(0).cast("long").alias("n"), F.lit(True).alias("asked")))
    by_day = marked.groupBy("day").agg(F.sum("n").alias("n"), F.bool_or("asked").alias("asked"))
    so_far = Window.partitionBy(F.lit(0)).orderBy("day").rowsBetween(Window.unboundedPreceding, 0)  # one row a day
    return by_day.withColumn("articles", F.sum("n").over(so_far)).filter("asked AND articles > 0").select("day", "articles")


BAR_SCHEMA = T.StructType([
    T.StructField("symbol", T.StringType(), False), T.StructField("ts", T.TimestampType(), False),
    *[T.StructField(n, T.DecimalType(18, 6), False) for n in ("open", "high", "low", "close", "volume")],
])
