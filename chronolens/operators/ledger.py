"""Append-only ledger of forecasts, calls and exclusions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DETAIL_LIMIT = 2000
SAMPLES = 3
USAGE_JSON = (
    "struct<session_id:string,total_cost_usd:string,modelUsage:map<string,struct<inputTokens:bigint,outputTokens:bigint,"
    "cacheReadInputTokens:bigint,cacheCreationInputTokens:bigint,costUSD:string>>>"
)


class DuplicateKeyError(ValueError):
    """A row whose key the ledger already holds, or that repeats within the batch."""


def append_unique(existing: DataFrame, rows: DataFrame, key: list[str], path: str | None = None) -> DataFrame:
    """existing with rows, written to path in one append if given. Nothing is written if any key is taken; there is no update and no delete."""
    repeated = rows.groupBy(*key).count().filter("count > 1")
    taken = rows.join(existing.select(*key), key, "left_semi")
    if repeated.limit(1).count() or taken.limit(1).count():
        raise DuplicateKeyError(f"rows repeat a key of {key}")
    if path:
        rows.write.mode("append").parquet(path)
    return existing.unionByName(rows)


def duplicates(existing: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """Keys of rows that the ledger must refuse."""
    return rows.groupBy(*key).count().filter("count > 1").select(*key).unionByName(rows.join(existing.select(*key), key, "left_semi").select(*key)).distinct()


def model_usage(calls: DataFrame, column: str = "payload") -> DataFrame:
    """One row a call and model, money read through text. A call without models, or an entry without a count or its cost, fails the job: it would meter as free."""
    used = F.from_json(column, USAGE_JSON, {"primitivesAsString": "false"})["modelUsage"]
    named = F.when(F.coalesce(F.size(used), F.lit(0)) > 0, used).otherwise(F.raise_error(F.lit("a call names no model")))
    rows = calls.select(*[c for c in calls.columns if c != column], F.explode(named).alias("model", "m"))

    def stated(field: str) -> Column:
        return F.coalesce(F.col(f"m.{field}"), F.raise_error(F.lit(f"a model's usage states no {field}")))

    tokens = [stated(n).alias(a) for n, a in (("inputTokens", "input"), ("outputTokens", "output"), ("cacheReadInputTokens", "cache_read"), ("cacheCreationInputTokens", "cache_write"))]
    return rows.select(*[c for c in calls.columns if c != column], "model", *tokens, stated("costUSD").try_cast("decimal(12,6)").alias("cost_usd"))


def spend_since(usage: DataFrame, since: Column, at: str = "at") -> DataFrame:
    return usage.filter(F.col(at) >= since).agg(F.coalesce(F.sum("cost_usd"), F.lit(0)).alias("spent"))


def tokens_of(usage: DataFrame, run: str = "run_id") -> DataFrame:
    return usage.groupBy(run).agg(F.sum(F.expr("input + output + cache_read + cache_write")).alias("tokens"))


def exclusion_counts(exclusions: DataFrame) -> DataFrame:
    return exclusions.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def with_detail(exclusions: DataFrame) -> DataFrame:
    return exclusions.withColumn("detail", F.left("detail", F.lit(DETAIL_LIMIT)))


def cost_of_forecasts(forecasts: DataFrame, usage: DataFrame, key: str = "issuer_day_hash") -> DataFrame:
    """Cost of the calls behind each group that has a forecast."""
    return usage.groupBy(key).agg(F.sum("cost_usd").alias("cost")).join(forecasts.select(key), key, "left_semi")


def sample_means(samples: DataFrame, key: list[str]) -> DataFrame:
    """Mean of exactly three valid samples; groups with another number have no forecast."""
    means = samples.filter(F.col("status") == "ok").groupBy(*key).agg(F.avg("p").alias("forecast"), F.count(F.lit(1)).alias("n"))
    return means.filter(F.col("n") == SAMPLES).drop("n")


def sample_status(p: Column, rationale: Column, refused: Column, failed: Column, limited: Column, kind: Column) -> Column:
    """ok, invalid, refused, error or rate_limited. kind: JSON type of the estimate; a boolean is not a number."""
    valid = (kind == "number") & p.between(0.0, 1.0) & (F.length(rationale) <= 600)
    return F.when(limited, "rate_limited").when(failed, "error").when(refused, "refused").when(F.coalesce(valid, F.lit(False)), "ok").otherwise("invalid")


def predicted(predictions: DataFrame, events: DataFrame, arm: str, version: str) -> DataFrame:
    return events.join(predictions.filter((F.col("arm") == arm) & (F.col("prompt_version") == version)).select("event_id"), "event_id", "left_semi")


def excluded_events(exclusions: DataFrame, events: DataFrame) -> DataFrame:
    return events.join(exclusions.select(F.explode("event_ids").alias("event_id")).distinct(), "event_id", "left_semi")


def group_state(groups: DataFrame, decided: DataFrame) -> DataFrame:
    """groups (group, event_id): done, new, or changed when only part of the group was decided before."""
    marked = groups.join(decided.select("event_id").distinct().withColumn("_d", F.lit(True)), "event_id", "left")
    known = F.coalesce("_d", F.lit(False))
    return marked.groupBy("group").agg(F.when(F.bool_and(known), "done").when(F.bool_or(known), "changed").otherwise("new").alias("state"))
