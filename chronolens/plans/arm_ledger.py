"""The ledger of an arm: forecasts, metered calls and exclusions in append-only tables, raised to the current declarations step by step."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ledger
from ..sources.commits import CommitLog, Field

ARM = "agent"
NOW = "current_timestamp()"

# Tables and columns, in the order of the declarations that brought them in.
PREDICTIONS = [
    Field("event_id", "string", False), Field("arm", "string", False), Field("model", "string", False), Field("prompt_version", "string", False),
    Field("packet_hash", "string", False), Field("horizon_days", "long", False), Field("issuer_day_hash", "string", False), Field("samples", "array<double>"),
    Field("rationales", "array<string>"), Field("estimate", "decimal(12,6)", False), Field("created_at", "timestamp", False, NOW),
]
CALLS = [
    Field("run_id", "string", False), Field("session_id", "string", False, "''"), Field("model", "string", False), Field("input", "long", False), Field("output", "long", False),
    Field("cache_read", "long", False), Field("cost_usd", "decimal(12,6)", False), Field("agent_name", "string"), Field("at", "timestamp", False, NOW),
]
ATTRIBUTION = [Field("issuer_day_hash", "string")]
CACHE_WRITES = [Field("cache_write", "long", False, "0")]
EXCLUSIONS = [
    Field("event_day", "date", False), Field("cik", "long", False), Field("issuer_day_hash", "string", False), Field("arm", "string", False), Field("prompt_version", "string", False),
    Field("reason", "string", False), Field("samples_valid", "long", False), Field("event_ids", "array<string>", False), Field("detail", "string", False, "''"), Field("created_at", "timestamp", False, NOW),
]
SAMPLES = [
    Field("run_id", "string", False), Field("issuer_day_hash", "string", False), Field("prompt_version", "string", False), Field("attempt", "long", False), Field("status", "string", False),
    Field("estimate", "double"), Field("rationale", "string"), Field("cost", "double", False, "0.0"), Field("tokens", "long", False, "0"), Field("at", "timestamp", False, NOW),
]
CLAIMS = [Field("run_id", "string", False), Field("issuer_day_hash", "string", False), Field("prompt_version", "string", False), Field("at", "timestamp", False, NOW)]
STEPS = [
    [("predictions", PREDICTIONS, [], ["horizon_days > 0"]), ("calls", CALLS, [], [])],
    [("calls", ATTRIBUTION, [], []), ("predictions", [], ["event_id", "arm", "prompt_version"], [])],
    [("calls", CACHE_WRITES, [], []), ("exclusions", EXCLUSIONS, ["issuer_day_hash", "arm", "prompt_version"], []), ("samples", SAMPLES, ["issuer_day_hash", "prompt_version", "attempt"], []),
     ("claims", CLAIMS, ["issuer_day_hash", "prompt_version"], [])],
]


def upgrade(log: CommitLog, to: int = len(STEPS)) -> int:
    """Declare what is missing up to a step; the number of declarations made. Steps already taken are left alone."""
    made = 0
    _, tables = log.tables()
    for step in STEPS[:to]:
        for name, fields, key, checks in step:
            known = tables.get(name)
            if known and {f.name for f in fields} <= {f.name for f in known.fields} and (not key or known.key):
                continue
            log.declare(name, fields, key, checks)
            made += 1
    return made


class ArmLedger:
    """What a run reads from and writes to the ledger."""

    def __init__(self, spark: SparkSession, root: str, arm: str = ARM):
        self.spark, self.log, self.arm = spark, CommitLog(spark, root), arm

    def _own(self, table: str, version: str) -> DataFrame:
        return self.log.read(table).filter((F.col("arm") == self.arm) & (F.col("prompt_version") == version))

    def predicted(self, version: str, events: DataFrame) -> DataFrame:
        return ledger.predicted(self.log.read("predictions"), events, self.arm, version)

    def excluded_events(self, version: str, events: DataFrame) -> DataFrame:
        return ledger.excluded_events(self._own("exclusions", version), events)

    def is_excluded(self, version: str, issuer_day_hash: str) -> bool:
        return bool(self._own("exclusions", version).filter(F.col("issuer_day_hash") == issuer_day_hash).limit(1).count())

    def forecasts(self, version: str) -> DataFrame:
        return self._own("predictions", version).select("event_id", "estimate")

    def exclusion_counts(self, version: str) -> DataFrame:
        return ledger.exclusion_counts(self._own("exclusions", version))

    def spent_since(self, instant: Column) -> DataFrame:
        return ledger.spend_since(self.log.read("calls"), instant)

    def tokens_for_run(self, run_id: str) -> int:
        found = ledger.tokens_of(self.log.read("calls").filter(F.col("run_id") == run_id)).first()
        return int(found["tokens"]) if found else 0

    def write_forecasts(self, rows: DataFrame) -> int | None:
        """rows: event_id, model, prompt_version, packet_hash, issuer_day_hash, horizon_days, samples, rationales, estimate; all or none."""
        return self.log.append({"predictions": rows.withColumn("arm", F.lit(self.arm))})

    def write_exclusions(self, rows: DataFrame) -> int | None:
        return self.log.append({"exclusions": ledger.with_detail(rows.withColumn("arm", F.lit(self.arm)))})

    def record_calls(self, calls: DataFrame) -> int | None:
        """calls: run_id, issuer_day_hash and payload, the usage record of one call; a row a model is metered."""
        return self.log.append({"calls": ledger.model_usage(calls).withColumn("agent_name", F.lit(self.arm))})

    def append(self, **rows: DataFrame) -> int | None:
        """Rows of several tables in one commit."""
        return self.log.append(rows)


def rows_of(spark: SparkSession, fields: Sequence[Field], rows: Sequence[tuple], names: Sequence[str]) -> DataFrame:
    """A small batch of rows under the declared types of the named columns."""
    types = {f.name: f.type for f in fields}
    return spark.createDataFrame(list(rows), ", ".join(f"`{n}` {types[n]}" for n in names))
