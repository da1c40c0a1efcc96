"""Source-side control flow around an injected fetch: paging, retries, isolating refused symbols, the history cache."""

from __future__ import annotations

import datetime as dt
import hashlib
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession

from ..operators.guards import GuardError, symbols_refused

ATTEMPTS = 4
CACHE_VERSION = 1


class RejectedError(ValueError):
    """The service refused a request for one of its symbols."""


class RecentWindowError(ValueError):
    """The requested window reaches into days the feed does not give yet."""


def pages(fetch: Callable[[str | None], dict], limit: int = 10_000) -> list[dict]:
    """All pages of a request; fetch takes the page token and returns a page with next_page_token."""
    found, token = [], None
    for _ in range(limit):
        page = fetch(token)
        found.append(page)
        token = page.get("next_page_token")
        if not token:
            return found
    raise GuardError("paging does not end")


def isolating(symbols: list[str], fetch: Callable[[list[str]], dict]) -> tuple[dict, list[str]]:
    """Results of all symbols the service takes, and those it refuses: a refused batch is halved down to single symbols."""
    try:
        return fetch(symbols), []
    except RejectedError:
        if len(symbols) == 1:
            return {}, symbols
    half = len(symbols) // 2
    (a, bad), (b, worse) = isolating(symbols[:half], fetch), isolating(symbols[half:], fetch)
    return {**a, **b}, bad + worse


def tolerating(symbols: list[str], fetch: Callable[[list[str]], dict]) -> tuple[dict, list[str]]:
    """isolating(), unless more than a quarter is refused."""
    found, refused = isolating(symbols, fetch) if symbols else ({}, [])
    if symbols_refused(len(refused), len(symbols)):
        raise GuardError(f"{len(refused)} of {len(symbols)} symbols were refused, among them {refused[:5]}")
    return found, refused


def checked_window(start: dt.date, end: dt.date, today: dt.date) -> tuple[dt.date, dt.date]:
    if end >= today:
        raise RecentWindowError(f"{end} is not before {today}")
    return start, end


def cached(spark: SparkSession, root: str, archives: Iterable[tuple[str, int, int]], build: Callable[[], DataFrame]) -> DataFrame:
    """build() once per fingerprint of the archives' names, sizes and times; later calls read the stored table."""
    key = hashlib.sha256(repr((CACHE_VERSION, sorted(archives))).encode()).hexdigest()[:32]
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{key}/_SUCCESS")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        build().write.mode("overwrite").parquet(f"{root}/{key}")
    return spark.read.parquet(f"{root}/{key}")
