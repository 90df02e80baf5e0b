"""The week calendar and run windows."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

START = dt.date(2019, 11, 26)
DAY, WEEK = dt.timedelta(days=1), dt.timedelta(days=7)


def week_list(start: str, end: str, days: int = 7) -> dict[str, dict[str, str]]:
    """week_1, week_2, ...: starts every ``days`` days up to end; each ends six days later."""
    a, b = dt.date.fromisoformat(start), dt.date.fromisoformat(end)
    starts = [a + dt.timedelta(days=days * i) for i in range((b - a).days // days + 1)] if b >= a else []
    return {
        f"week_{i}": {"weekly_start_date": str(s), "weekly_end_date": str(s + dt.timedelta(days=6))} for i, s in enumerate(starts, 1)
    }


def week_frame(spark: SparkSession, start: str, end: str) -> DataFrame:
    s = F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"), F.expr("interval 7 days"))
    return spark.range(1).select(F.explode(s).alias("week_start")).withColumn("week_end", F.date_add("week_start", 6))


def parse_date(text: str) -> dt.date:
    """A day as YYYY-MM-DD or, in folder names, YYMMDD."""
    if len(text) == 6 and text.isdigit():
        text = f"20{text[:2]}-{text[2:4]}-{text[4:]}"
    try:
        return dt.date.fromisoformat(text)
    except ValueError:
        raise ValueError(f"neither YYYY-MM-DD nor YYMMDD: {text}") from None


def folder(prefix: str, start: str) -> tuple[str, str]:
    """(prefix/YYMMDD/, last day of that week)."""
    d = parse_date(start)
    return f"{prefix.rstrip('/')}/{d:%y%m%d}/", str(d + dt.timedelta(days=6))


def run_window(current: str, start: dt.date = START) -> dict[str, str]:
    """The week to load when the clock stands at current: the bin of the calendar anchored at
    ``start`` that comes before the clock's own bin. The clock then goes on by a bin."""
    clock = dt.date.fromisoformat(current)
    own_bin = clock - (clock - start) % WEEK
    return {"start_date": str(own_bin - WEEK), "end_date": str(own_bin - DAY), "next_date": str(clock + WEEK)}
