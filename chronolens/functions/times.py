"""Eastern and UTC time; `today` is always a parameter."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

EASTERN = "America/New_York"


def acceptance_utc(naive_eastern: Column) -> Column:
    """Instant of an acceptance time published without zone; NULL stays NULL and is to be excluded."""
    return F.to_utc_timestamp(naive_eastern, EASTERN)


def eastern_date(instant: Column) -> Column:
    return F.to_date(F.from_utc_timestamp(instant, EASTERN))


def session_close(session: Column) -> Column:
    """16:00 Eastern of a session date as an instant; early closes are not modelled."""
    return F.to_utc_timestamp(session.cast("timestamp") + F.expr("INTERVAL 16 HOURS"), EASTERN)


def start_of_day(instant: Column) -> Column:
    return F.to_utc_timestamp(F.date_trunc("day", F.from_utc_timestamp(instant, EASTERN)), EASTERN)


def entry_key(instant: Column) -> tuple[Column, Column]:
    """Eastern date, and whether before 09:30: the open at which a filing's window starts."""
    local = F.from_utc_timestamp(instant, EASTERN)
    return F.to_date(local), F.date_format(local, "HH:mm:ss") < "09:30:00"


def iso_instant(c: Column) -> Column:
    return F.to_timestamp(c)


def newest_permitted_end(end: dt.date, today: dt.date) -> dt.date:
    """The consolidated feed is free only for days before today."""
    if end >= today:
        return today - dt.timedelta(days=1)
    return end
