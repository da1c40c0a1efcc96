import json

import pytest

from chronolens.operators import calls
from chronolens.sources import readers

ALLOWED = calls.Isolation("model-1", plugins=frozenset({"a@builtin", "b@builtin"}))
START = {"type": "system", "subtype": "init", "tools": ["StructuredOutput"], "mcp_servers": [], "model": "model-1", "skills": [], "slash_commands": [], "output_style": "default", "permissionMode": "default", "apiKeySource": "none", "plugins": [{"source": "b@builtin", "name": "b"}, {"source": "a@builtin"}]}
LIMIT = {"type": "rate_limit_event", "rate_limit_info": {"status": "allowed", "unifiedWindows": {"five_hour": {"utilization": 0.32}, "seven_day": {"utilization": 0.24}}}}
RESULT = {"type": "result", "subtype": "success", "is_error": False, "api_error_status": None, "stop_reason": "end_turn", "modelUsage": {"model-1": {"costUSD": 0.1}}, "result": "r", "structured_output": {"p_up": 0.5, "rationale": "because"}}
THINKING = {"type": "system", "subtype": "thinking_tokens"}


def stream(*events):
    return "\n".join(e if isinstance(e, str) else json.dumps(e) for e in events)


def result(**changes):
    return {**RESULT, **changes}


def limit(status="rejected", **windows):
    return {"type": "rate_limit_event", "rate_limit_info": {"status": status, "unifiedWindows": windows}}


def judged(spark, cases):
    """cases: name -> (text, returncode, stderr)."""
    streams = spark.createDataFrame([(n, c[0]) for n, c in cases.items()], "call string, text string")
    ends = spark.createDataFrame([(n, c[1], c[2]) for n, c in cases.items()], "call string, returncode int, stderr string")
    found = calls.judge_calls(calls.fold_calls(calls.call_lines(streams).repartition(3)), ends, ALLOWED)
    return {r["call"]: r for r in found.collect()}


def test_how_calls_end(spark):
    good = (START, THINKING, LIMIT, RESULT)
    answer = lambda p, why="r": stream(START, result(structured_output={"p_up": p, "rationale": why}))
    cases = {
        "good": (stream(*good), 0, ""), "stray": (stream("Warning: something", START, "[1, 2]", '{"cut', LIMIT, RESULT), 0, ""), "low": (answer(0), 0, ""), "high": (answer(1.0), 0, ""),
        "over": (answer(1.01), 0, ""), "text": (answer("0.5"), 0, ""), "true": (answer(True), 0, ""), "long": (answer(0.5, "x" * 601), 0, ""), "just": (answer(0.5, "é" * 600), 0, ""),
        "unsaid": (stream(START, result(structured_output=None)), 0, ""), "refused": (stream(START, result(stop_reason="refusal")), 0, ""), "stopped": (stream(START, result(safety_stops=[1])), 0, ""),
        "warned": (stream(START, limit("allowed_warning"), RESULT), 0, ""), "exhausted": (stream(START, limit(), result(is_error=True)), 1, ""), "warned-failed": (stream(START, limit("allowed_warning"), result(is_error=True, result="boom")), 1, "trace"),
        "429": (stream(START, result(is_error=True, api_error_status=429)), 1, ""), "errored": (stream(START, result(is_error=True, subtype="during")), 0, ""), "silent": ("", 1, "no such thing"),
        "cut": (stream(START, THINKING, json.dumps(RESULT)[:40]), 143, ""), "unstarted": (stream(LIMIT, RESULT), 0, ""), "exit": (stream(*good), 2, ""), "rejected-unsaid": (stream(START, limit(), result(structured_output={})), 0, ""),
        "odd-windows": (stream(START, {"type": "rate_limit_event", "rate_limit_info": "soon"}, limit("allowed", a={"utilization": "much"}, b={"utilization": 1}, c=3), RESULT), 0, ""),
        "last-window": (stream(START, LIMIT, limit("allowed", five_hour={"utilization": 0.9}), RESULT, result(structured_output={"p_up": 0.9, "rationale": "later"})), 0, ""), "carriage": (stream(*good).replace("\n", "\r\n"), 0, ""),
    }
    got = judged(spark, cases)
    want = dict.fromkeys(("good", "stray", "low", "high", "just", "warned", "odd-windows", "last-window", "carriage"), "ok") | dict.fromkeys(("over", "text", "true", "long", "unsaid"), "invalid_output")
    want |= dict.fromkeys(("refused", "stopped"), "refused") | dict.fromkeys(("exhausted", "429", "rejected-unsaid"), "rate_limited") | dict.fromkeys(("warned-failed", "errored", "silent", "cut", "unstarted", "exit"), "error")
    assert {n: r["status"] for n, r in got.items()} == want and all(r["problems"] == [] for r in got.values())
    assert (got["good"]["estimate"], got["good"]["rationale"], got["good"]["windows"]) == (0.5, "because", {"five_hour": 0.32, "seven_day": 0.24})
    assert all((r["estimate"] is None) == (r["status"] != "ok") for r in got.values()) and (got["low"]["estimate"], got["high"]["estimate"]) == (0.0, 1.0)
    assert json.loads(got["unstarted"]["payload"])["modelUsage"] and "startup" in got["unstarted"]["detail"] and got["cut"]["payload"] is None and "exit 143, no result" in got["cut"]["detail"]
    assert "no such thing" in got["silent"]["detail"] and got["warned-failed"]["detail"] == "exit 1, success: boom"
    assert got["odd-windows"]["windows"] == {"b": 1.0} and got["last-window"]["windows"] == {"five_hour": 0.9, "seven_day": 0.24} and got["last-window"]["estimate"] == 0.5


def test_calls_that_were_not_isolated_stop_the_run(spark):
    changes = {"tools": ["StructuredOutput", "Shell"], "mcp_servers": [{"name": "x"}], "model": "model-2", "skills": ["s"], "slash_commands": ["c"], "output_style": "loud", "permissionMode": "all", "apiKeySource": "key", "plugins": [{"source": "a@builtin"}]}
    cases = {k: (stream({**START, k: v}, RESULT), 0, "") for k, v in changes.items()} | {"gone": (stream({k: v for k, v in START.items() if k != "tools"}, RESULT), 0, ""), "second": (stream(START, result(modelUsage={"model-1": {}, "model-2": {}})), 0, ""), "fine": (stream(START, RESULT), 0, "")}
    got = judged(spark, cases)
    assert {n for n, r in got.items() if not r["problems"]} == {"fine"} and got["second"]["problems"] == ["usage of another model"] and got["tools"]["problems"] == ["tools"]
    rows = spark.createDataFrame([(n, r["problems"]) for n, r in got.items()], "call string, problems array<string>")
    calls.require_isolated(rows.filter("call = 'fine'"))
    with pytest.raises(calls.EnvironmentViolationError, match="second: usage of another model"):
        calls.require_isolated(rows.filter("call IN ('fine', 'second')"))


def test_captured_streams_are_read_by_file(spark, tmp_path):
    for name, text in (("one", stream(START, RESULT)), ("two", stream("noise", START))):
        (tmp_path / f"{name}.jsonl").write_text(text)
    lines = readers.call_streams(spark, str(tmp_path))
    folded = {r["call"]: r for r in calls.fold_calls(lines).collect()}
    assert json.loads(folded["one"]["result"]) == RESULT and folded["two"]["result"] is None and json.loads(folded["two"]["start"]) == START
    none = spark.createDataFrame([], "call string, returncode int, stderr string")
    assert calls.judge_calls(calls.fold_calls(lines.limit(0)), none, ALLOWED).count() == 0
    alone = spark.createDataFrame([("three", 0, None)], none.schema)
    assert [(r["status"], r["windows"]) for r in calls.judge_calls(calls.fold_calls(lines), alone, ALLOWED).collect()] == [("error", {})]
