"""Streams of model calls: the lines of a call are folded into its start, its result and its limits, then judged as one row.

A call prints one JSON object a line; other lines (warnings, a line cut off by a killed process) cost themselves only.
The fold is one aggregation by call that keeps the first start, the first result and each usage window's last reading by
line number, so it combines before the shuffle and the order of arrival does not matter. Isolation and status are
expressions over that row.

Defined cases: a call without a start or a result is an error, its usage is still there to be metered; a call of which
only an end is known is an error too; lines that repeat a number are all read; windows whose reading is no number are
left out; an empty table gives an empty one.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .guards import GuardError

RATIONALE_LIMIT = 600
SHOWN = 500
LINE_END = "\r\n|[\n\r\u000b\u000c\u001c\u001d\u001e\u0085  ]"


class EnvironmentViolationError(GuardError):
    """A call ran with tools, memory, settings or a model it must not have."""


@dataclass(frozen=True)
class Isolation:
    """What the start of a call must show."""

    model: str
    tools: tuple[str, ...] = ("StructuredOutput",)
    plugins: frozenset[str] = frozenset()
    style: str = "default"
    permission: str = "default"
    key_source: str = "none"


def _text(json: Column, path: str) -> Column:
    return F.get_json_object(json, path)


def _given(value: Column) -> Column:
    """Whether a JSON value is there and not empty, zero or false."""
    return value.isNotNull() & ~value.isin("", "false", "0", "0.0", "[]", "{}")


def _kind(json: Column, path: str) -> Column:
    """JSON type of a value: BIGINT, DECIMAL…, DOUBLE, STRING, BOOLEAN, OBJECT…, ARRAY… or NULL."""
    return F.schema_of_variant(F.try_variant_get(F.try_parse_json(json), path, "variant"))


def call_lines(streams: DataFrame, call: str = "call", text: str = "text") -> DataFrame:
    """call, seq and value of the lines of whole streams."""
    return streams.select(call, F.posexplode(F.split(text, LINE_END)).alias("seq", "value")).filter("value <> ''")


def fold_calls(lines: DataFrame, call: str = "call") -> DataFrame:
    """call, start and result (JSON), windows (last use of each), rejected; lines: call, seq, value."""
    read = lines.select(call, "seq", "value", F.try_parse_json("value").alias("v")).filter(F.schema_of_variant("v").startswith("OBJECT"))
    typed = read.select(call, "seq", "value", _text(F.col("value"), "$.type").alias("type"), _text(F.col("value"), "$.subtype").alias("subtype"))
    first = lambda wanted: F.min_by(F.when(wanted, F.col("value")), F.when(wanted, F.col("seq")))
    limit = F.col("type") == "rate_limit_event"
    rejected = F.coalesce(limit & (_text(F.col("value"), "$.rate_limit_info.status") == "rejected"), F.lit(False))
    calls = typed.groupBy(call).agg(
        first((F.col("type") == "system") & (F.col("subtype") == "init")).alias("start"), first(F.col("type") == "result").alias("result"), F.bool_or(rejected).alias("rejected")
    )
    used = F.from_json(_text(F.col("value"), "$.rate_limit_info.unifiedWindows"), "map<string,string>")
    windows = typed.filter(limit).select(call, "seq", F.explode(used).alias("name", "window"))
    number = _kind(F.col("window"), "$.utilization").rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)")
    last = windows.filter(number).groupBy(call, "name").agg(F.max_by(_text(F.col("window"), "$.utilization").cast("double"), "seq").alias("use"))
    listed = last.groupBy(F.col(call).alias("_call")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "use")))).alias("windows"))
    return calls.join(listed, F.col(call).eqNullSafe(F.col("_call")), "left").drop("_call")


def isolation_problems(start: Column, allowed: Isolation) -> Column:
    """What of the start of a call is not as it must be, as a list of texts."""
    listed = lambda path: F.from_json(_text(start, path), "array<string>")
    plugins = F.array_sort(F.array_distinct(F.transform(F.coalesce(F.from_json(_text(start, "$.plugins"), "array<string>"), F.array().cast("array<string>")), lambda p: F.coalesce(_text(p, "$.source"), F.lit("")))))
    checks = {
        "tools": ~listed("$.tools").eqNullSafe(F.array(*map(F.lit, allowed.tools)).cast("array<string>")),
        "servers": _given(_text(start, "$.mcp_servers")),
        "model": ~_text(start, "$.model").eqNullSafe(F.lit(allowed.model)),
        "skills": _given(_text(start, "$.skills")),
        "slash commands": _given(_text(start, "$.slash_commands")),
        "output style": ~_text(start, "$.output_style").eqNullSafe(F.lit(allowed.style)),
        "permission mode": ~_text(start, "$.permissionMode").eqNullSafe(F.lit(allowed.permission)),
        "key source": ~_text(start, "$.apiKeySource").eqNullSafe(F.lit(allowed.key_source)),
        "plugins": plugins != F.array(*map(F.lit, sorted(allowed.plugins))).cast("array<string>"),
    }
    return F.array_compact(F.array(*[F.when(wrong, name) for name, wrong in checks.items()]))


def judge_calls(calls: DataFrame, ends: DataFrame, allowed: Isolation, call: str = "call") -> DataFrame:
    """One row a call that ended (call, returncode, stderr): problems, status, estimate, rationale, detail, payload, windows.

    problems of the start, and models other than the allowed one, void the whole run: see require_isolated().
    """
    both = ends.join(calls.withColumnRenamed(call, "_call"), F.col(call).eqNullSafe(F.col("_call")), "left").drop("_call")
    start, result = F.col("start"), F.col("result")
    models = F.map_keys(F.from_json(_text(result, "$.modelUsage"), "map<string,string>"))
    foreign = F.coalesce(F.size(F.array_except(models, F.array(F.lit(allowed.model)))) > 0, F.lit(False))
    problems = F.when(start.isNotNull(), isolation_problems(start, allowed)).otherwise(F.array().cast("array<string>"))
    problems = F.when(start.isNotNull() & foreign, F.concat(problems, F.array(F.lit("usage of another model")))).otherwise(problems)
    limited = F.coalesce("rejected", F.lit(False)) | F.coalesce(_text(result, "$.api_error_status") == "429", F.lit(False))
    failed = _given(_text(result, "$.is_error")) | (F.col("returncode") != 0)
    refused = _given(_text(result, "$.safety_stops")) | F.coalesce(_text(result, "$.stop_reason") == "refusal", F.lit(False))
    estimate = F.when(_kind(result, "$.structured_output.p_up").rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), _text(result, "$.structured_output.p_up").cast("double"))
    rationale = F.when(_kind(result, "$.structured_output.rationale") == "STRING", _text(result, "$.structured_output.rationale"))
    valid = F.coalesce(estimate.between(0.0, 1.0) & (F.length(rationale) <= RATIONALE_LIMIT), F.lit(False))
    status = (
        F.when(start.isNull() | result.isNull(), "error").when(failed, F.when(limited, "rate_limited").otherwise("error"))
        .when(refused, "refused").when(valid, "ok").when(limited, "rate_limited").otherwise("invalid_output")
    )
    code = F.concat(F.lit("exit "), F.col("returncode").cast("string"))
    missing = F.concat(code, F.when(start.isNull(), ", no startup event: ").otherwise(", no result event: "), F.right(F.coalesce("stderr", F.lit("")), F.lit(SHOWN)))
    said = F.concat(code, F.lit(", "), F.coalesce(_text(result, "$.subtype"), F.lit("")), F.lit(": "), F.left(F.coalesce(_text(result, "$.result"), F.lit("")), F.lit(SHOWN)))
    detail = F.when(start.isNull() | result.isNull(), missing).when(F.col("status") == "error", said).when(F.col("status").isin("invalid_output", "rate_limited"), F.left(F.coalesce(_text(result, "$.structured_output"), F.lit("")), F.lit(SHOWN))).otherwise("")
    rows = both.withColumn("problems", problems).withColumn("status", status).withColumn("detail", detail)
    answered = F.col("status") == "ok"
    return rows.select(
        *ends.columns, "problems", "status", F.when(answered, estimate).alias("estimate"), F.when(answered, rationale).alias("rationale"), "detail", result.alias("payload"),
        F.coalesce("windows", F.create_map().cast("map<string,double>")).alias("windows"),
    )


def require_isolated(judged: DataFrame, call: str = "call") -> None:
    """Raise if any call did not run isolated."""
    wrong = judged.filter(F.size("problems") > 0).select(F.col(call).cast("string").alias("call"), F.concat_ws(", ", "problems").alias("said")).orderBy("call").limit(5).collect()
    if wrong:
        raise EnvironmentViolationError("calls did not run isolated: " + "; ".join(f"{r['call']}: {r['said']}" for r in wrong))
