"""Calendar arithmetic with one stated meaning for each unit.

Days count midnights, weeks count Mondays, months count firsts of months passed between two
moments, whatever their times of day.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

ANCHOR = "2019-10-01"


def day(c: Column | str) -> Column:
    return F.to_date(c)


def month(c: Column | str) -> Column:
    return F.trunc(F.to_date(c), "month")


def week(c: Column | str) -> Column:
    """The Monday on or before."""
    return F.trunc(F.to_date(c), "week")


def day_steps(a: Column | str, b: Column | str) -> Column:
    return F.datediff(day(b), day(a)).cast("long")


def week_steps(a: Column | str, b: Column | str) -> Column:
    return (F.datediff(week(b), week(a)) / 7).cast("long")


def month_steps(a: Column | str, b: Column | str) -> Column:
    a, b = day(a), day(b)
    return ((F.year(b) - F.year(a)) * 12 + F.month(b) - F.month(a)).cast("long")


def bin_start(c: Column | str, anchor: str = ANCHOR, days: int = 7) -> Column:
    """First day of the bin of ``days`` days, counted from anchor, that holds c."""
    a = F.lit(anchor).cast("date")
    return F.date_add(a, (F.floor(F.datediff(day(c), a) / days) * days).cast("int"))


def year_month(c: Column | str) -> Column:
    return F.date_format(c, "yyyy-MM")


def in_window(c: Column, start: str, end: str, inclusive_midnight: bool = False) -> Column:
    """start <= c < end + 1 day. inclusive_midnight: the literal BETWEEN start AND end of
    timestamps, which loses all of the last day but its midnight."""
    a, b = F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")
    if inclusive_midnight:
        return c.between(a, b)
    return (c >= a) & (c < F.lit(str(dt.date.fromisoformat(end) + dt.timedelta(days=1))).cast("timestamp_ntz"))


def date_slice(df, start: str, end: str):
    """Rows whose first ``*ymd`` column lies in start..end, both included; those columns as dates."""
    ymd = [c for c in df.columns if c.endswith("ymd")]
    if not ymd:
        raise ValueError("no column whose name ends with ymd")
    return df.withColumns({c: F.to_date(c) for c in ymd}).filter(F.col(ymd[0]).between(start, end))
