"""Day-by-day orchestration over the manifest: skip, retry, hold, fail."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from ..operators.guards import GuardError, backfill_broken


class WindowsStillOpenError(RuntimeError):
    """Some outcome window of the day has not closed; nothing was written."""


class TransportError(RuntimeError):
    """A source could not be reached."""


@dataclass
class BackfillReport:
    completed: list[str] = field(default_factory=list)
    skipped: list[str] = field(default_factory=list)
    pending: list[str] = field(default_factory=list)
    failed: dict[str, str] = field(default_factory=dict)


def with_retries(step: Callable[[], None], attempts: int = 3, first_wait: float = 5.0, sleep: Callable[[float], None] = time.sleep) -> None:
    """Transport failures only, waiting twice as long each time."""
    for k in range(attempts):
        try:
            return step()
        except TransportError:
            if k == attempts - 1:
                raise
            sleep(first_wait * 2**k)
    return None


def backfill(days: Iterable[str], done: set[str], run_day: Callable[[str], None], sleep: Callable[[float], None] = time.sleep) -> BackfillReport:
    report = BackfillReport()
    for day in days:
        if day in done:
            report.skipped.append(day)
            continue
        try:
            with_retries(lambda day=day: run_day(day), sleep=sleep)
            report.completed.append(day)
        except WindowsStillOpenError:
            report.pending.append(day)
        except (TransportError, ValueError, GuardError) as error:
            report.failed[day] = str(error)
            if backfill_broken(len(report.failed), len(report.failed) + len(report.completed)):
                raise GuardError(f"{len(report.failed)} days failed") from error
    return report


def resolve_domains(day: str, domains: Iterable[str], resolve: Callable[[str, str], None]) -> None:
    """Every domain is tried; the last hold is raised after the others have written."""
    held = None
    for domain in domains:
        try:
            resolve(day, domain)
        except WindowsStillOpenError as error:
            held = error
    if held:
        raise held
