"""Group runs of an injected forecaster: three samples a group, one retry each, exclusion or halt on failure."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, field
from typing import Protocol

from ..operators.calls import EnvironmentViolationError
from ..operators.ledger import SAMPLES


@dataclass
class Sample:
    status: str
    estimate: float | None = None
    cost: float = 0.0
    tokens: int = 0
    detail: str = ""
    rationale: str | None = None
    payload: str | None = None
    windows: Mapping[str, float] = field(default_factory=dict)


class Forecaster(Protocol):
    def sample(self, prompt: str) -> Sample: ...


@dataclass
class RunReport:
    forecasts: dict[str, float] = field(default_factory=dict)
    excluded: dict[str, str] = field(default_factory=dict)
    halted: str | None = None
    largest_cost: float = 0.0
    largest_tokens: int = 0


def prompt_version(template: str, schema: Mapping, model: str, effort: str, code: str, samples: int = SAMPLES) -> str:
    identity = json.dumps([template, schema, model, effort, samples, code], sort_keys=True, ensure_ascii=False)
    return hashlib.sha256(identity.encode()).hexdigest()[:16]


def require_isolation(started: Mapping, allowed: Mapping) -> None:
    """Every listed setting of the start event must have its allowed value."""
    if wrong := {k: started.get(k) for k, v in allowed.items() if started.get(k) != v}:
        raise EnvironmentViolationError(f"the call did not run isolated: {wrong}")


def run_groups(groups: Iterable[tuple[str, str]], forecaster: Forecaster, halt_reason: Callable[[RunReport], str | None] = lambda _: None) -> RunReport:
    """groups of (hash, prompt) in order. A sample that fails twice excludes its group; a limit or an outage halts the run."""
    report = RunReport()
    for key, prompt in groups:
        if reason := halt_reason(report):
            report.halted = reason
            break
        estimates: list[float] = []
        for _ in range(SAMPLES):
            for _ in range(2):
                got = forecaster.sample(prompt)
                report.largest_cost, report.largest_tokens = max(report.largest_cost, got.cost), max(report.largest_tokens, got.tokens)
                if got.status in ("ok", "rate_limited"):
                    break
            if got.status == "rate_limited":
                report.halted = "rate limited"
                return report
            if got.status != "ok":
                report.excluded[key] = got.status
                break
            estimates.append(float(got.estimate))
        if len(estimates) == SAMPLES:
            report.forecasts[key] = sum(estimates) / SAMPLES
    return report
