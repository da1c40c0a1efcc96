"""Run guards: shares of failures beyond which a day or a run must not be stored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class GuardError(RuntimeError):
    """A share of failures that points to a broken source instead of bad rows."""


class BudgetExceededError(GuardError):
    """Spending or tokens at or above the ceiling."""


def parse_breakage(rejected: int, attempted: int, unlistable: int = 0, untimestamped: int = 0, limit: float = 0.05) -> bool:
    """More than `limit` rejected; unlistable issuers are no attempts, untimestamped filings count on both sides."""
    bad, all_ = rejected + untimestamped, attempted - unlistable + untimestamped
    return all_ > 0 and bad / all_ > limit


def systemic(failed: int, attempted: int, at_least: int, limit: float) -> bool:
    return attempted >= at_least and failed / attempted > limit


def ticker_reads_broken(failed: int, reads: int) -> bool:
    return systemic(failed, reads, 5, 0.5)


def labels_broken(unmeasurable: int, ripe: int) -> bool:
    return systemic(unmeasurable, ripe, 10, 0.5)


def symbols_refused(refused: int, asked: int) -> bool:
    return systemic(refused, asked, 1, 0.25)


def backfill_broken(failed: int, attempted: int) -> bool:
    return systemic(failed, attempted, 4, 0.25)


def require(condition: bool, message: str) -> None:
    if not condition:
        raise GuardError(message)


def none_left(df: DataFrame, message: str) -> None:
    """Fail fast when df has a row."""
    first = df.limit(1).collect()
    require(not first, f"{message}: {first[0].asDict() if first else ''}")


def assert_spend(spent: float, ceiling: float, pending: float = 0.0) -> None:
    """The ceiling itself is out of bounds; a negative pending cost is a caller's error."""
    if pending < 0:
        raise ValueError("pending cost is negative")
    if spent + pending >= ceiling:
        raise BudgetExceededError(f"{spent} spent and {pending} pending reach the ceiling of {ceiling}")


def assert_tokens(used: int, ceiling: int, pending: int = 0) -> None:
    if pending < 0:
        raise ValueError("pending tokens are negative")
    if used + pending >= ceiling:
        raise BudgetExceededError(f"{used} used and {pending} pending reach the ceiling of {ceiling}")


def rejection_share(rejected: Column, listable: Column) -> DataFrame:
    """rejected / attempted as one aggregate; listable marks rows that count as attempts."""
    return F.sum(rejected.cast("long")) / F.nullif(F.sum(listable.cast("double")), F.lit(0.0))


def is_retryable(transport_failed: bool, status: int | None) -> bool:
    return transport_failed or status == 429 or (status is not None and status >= 500)


def within_run_limits(calls: int, max_calls: int, weekly_share: float, max_share: float, spent: float, ceiling: float, worst_call: float, tokens: int, max_tokens: int, worst_tokens: int, worst_calls: int = 6) -> str | None:
    """The reason to halt before the next group, which may need worst_calls calls; None to go on."""
    if calls + worst_calls > max_calls:
        return "call limit"
    if weekly_share >= max_share:
        return "usage window"
    if spent + worst_calls * worst_call > ceiling:
        return "spend ceiling"
    if tokens + worst_calls * worst_tokens > max_tokens:
        return "token ceiling"
    return None
