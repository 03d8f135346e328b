"""Date keys, truncation and relative-time filters (all time-zone free on TIMESTAMP_NTZ)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F


def date_sk(day: Column) -> Column:
    """yyyymmdd integer key by arithmetic (no formatter object per row)."""
    return (F.year(day) * 10000 + F.month(day) * 100 + F.dayofmonth(day)).cast("int")


def day_number(day: Column) -> Column:
    """Days since 1970-01-01; the integer axis for range frames."""
    return F.unix_date(day.cast("date"))


def hour_start(ts: str) -> Column:
    """Start of the hour of an NTZ column.

    ``date_trunc`` would turn NTZ into a zoned timestamp and back, which is wrong in
    zones with clock changes; adding whole hours to midnight is not.
    """
    return F.expr(f"timestampadd(HOUR, hour({ts}), cast(cast({ts} AS date) AS timestamp_ntz))")


def month_start(day: Column) -> Column:
    return F.trunc(day, "month")


def quarter_label(day: Column) -> Column:
    return F.concat(F.year(day).cast("string"), F.lit("-Q"), F.quarter(day).cast("string"))


def as_date(value: dt.date | str | Column) -> Column:
    return value if isinstance(value, Column) else F.lit(str(value)).cast("date")


def as_ntz(value: dt.datetime | str | Column) -> Column:
    return value if isinstance(value, Column) else F.lit(str(value)).cast("timestamp_ntz")


def wall_micros(ts: Column) -> Column:
    """Microseconds of an NTZ column since 1970-01-01 on its own clock, whatever the session zone."""
    seconds = F.hour(ts) * 3600 + F.minute(ts) * 60
    fraction = (F.date_part(F.lit("SECOND"), ts) * 1_000_000).cast("bigint")
    return F.unix_date(ts.cast("date")).cast("bigint") * 86_400_000_000 + seconds.cast("bigint") * 1_000_000 + fraction


def minutes_between(start: Column, end: Column) -> Column:
    return (wall_micros(end) - wall_micros(start)).cast("double") / F.lit(60_000_000.0)
