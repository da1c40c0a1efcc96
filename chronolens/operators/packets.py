"""Evidence packets: lookahead and renderability checks, groups of one issuer and opening, prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import canonical, text, times

OPEN, CLOSE = "<untrusted_data>", "</untrusted_data>"


class LookaheadError(ValueError):
    """A packet holds something that was not known at its instant."""


class UnsupportedPacketError(ValueError):
    """A packet the prompt cannot show in full."""


def lookahead(packets: DataFrame) -> DataFrame:
    """Packets (as_of, bars with session, comparables with resolved_at) that hold a bar not yet closed or a case not yet resolved."""
    late_bar = F.exists("bars", lambda b: times.session_close(b["session"]) > F.col("as_of"))
    late_case = F.exists("comparables", lambda c: c["resolved_at"] > F.col("as_of"))
    return packets.filter(F.col("as_of").isNull() | F.coalesce(late_bar, F.lit(False)) | F.coalesce(late_case, F.lit(False)))


def unrenderable(packets: DataFrame) -> DataFrame:
    """Packets of another domain, or with sections or comparables."""
    return packets.filter((F.col("domain") != "insider") | (F.size("sections") > 0) | (F.size("comparables") > 0))


def series_union(base: DataFrame, override: DataFrame) -> DataFrame:
    """Union of two series tables by (symbol, session); where both have a row, the second's counts."""
    ranked = base.withColumn("_p", F.lit(0)).unionByName(override.withColumn("_p", F.lit(1)))
    own = [c for c in base.columns if c not in ("symbol", "session")]
    last = ranked.groupBy("symbol", "session").agg(F.max(F.struct("_p", *own)).alias("_r"))
    return last.select("symbol", "session", *[F.col(f"_r.{c}").alias(c) for c in own])


def first_packets(packets: DataFrame) -> DataFrame:
    """The packet a filing's forecast cites: its first in acceptance order, ties by content."""
    return packets.groupBy("event_id").agg(F.min_by("content_hash", F.struct("as_of", "content_hash")).alias("content_hash"))


def issuer_day_groups(packets: DataFrame) -> DataFrame:
    """cik, entry_day, before_open with event_ids in acceptance order (each once), the group's hash and its packets in order.

    Bars and statistics to show are those of the first packet: nothing another filing of the group could not have seen.
    """
    day, early = times.entry_key(F.col("as_of"))
    own = [c for c in packets.columns if c not in ("as_of", "event_id", "content_hash", "cik")]
    ordered = F.array_sort(F.collect_list(F.struct("as_of", "event_id", "content_hash", *own)))
    grouped = packets.groupBy("cik", day.alias("entry_day"), early.alias("before_open")).agg(ordered.alias("packets"), canonical.group_hash(F.col("content_hash")).alias("issuer_day_hash"))
    return grouped.withColumn("event_ids", F.array_distinct(F.transform("packets", lambda p: p["event_id"])))


def rendered(groups: DataFrame, fields: list[str]) -> DataFrame:
    """groups with prompt: one fenced line a packet, its named fields as single-line text. Text fields must be sanitised before grouping."""

    def line(p: Column) -> Column:
        accepted = F.concat(F.lit("- accepted "), F.date_format(p["as_of"], "yyyy-MM-dd'T'HH:mm:ss'+00:00'"))
        return F.concat_ws(" | ", accepted, *[F.concat(F.lit(f"{n} "), F.coalesce(p[n].cast("string"), F.lit("n/a"))) for n in fields])

    body = F.array_join(F.transform("packets", line), "\n")
    return groups.withColumn("prompt", F.concat_ws("\n", F.lit(OPEN), body, F.lit(CLOSE)))


def sanitised_packets(packets: DataFrame, texts: list[str], numbers: list[str]) -> DataFrame:
    return packets.withColumns({**{c: text.sanitised(F.col(c)) for c in texts}, **{c: text.plain_number(F.col(c)) for c in numbers}})


def require(packets: DataFrame) -> None:
    """Raise for the first packet that looks ahead or cannot be shown."""
    if bad := lookahead(packets).limit(1).collect():
        raise LookaheadError(f"packet {bad[0]['event_id']} holds information from after {bad[0]['as_of']}")
    if bad := unrenderable(packets).limit(1).collect():
        raise UnsupportedPacketError(f"packet {bad[0]['event_id']} cannot be shown in full")
