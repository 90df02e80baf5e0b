"""Incremental refresh of staging and the analysis tables: a load computes and writes what it touches.

State. Tables of increments under the same root, each load's rows appended and put together on reading
by the measures' own aggregates (sums, minima, maxima), so a load never rewrites history:

    hours       events, sessions and revenue by day, hour and type
    brands      revenue by month, second category level and brand
    user_days   the days on which a user had events (each pair once), by month folders
    sessions    the sessions of a day and whether they bought (each once), by month folders
    first_seen  a user's first event
    buyers      a user's purchases: last, number, revenue
    newest      the latest event
    cohorts     users by month of first event
    ret_day, ret_week, ret_month   users by cohort and step

Retention needs no pass over history: of the users who are active on new days, contributions are
computed before and after the load, and the differences are added. So late events, which move a user
to an earlier cohort, are right too.

Results. A table's rows come in units (a day, a month, a cohort): a load computes the units it touches
from state and appends them; the newest version of a unit counts, and an empty version stands for a
unit that has gone. RFM scores are ranks among all users, so they alone are published as a whole,
from buyers rather than from events; the grand total of daily revenue is added on reading.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import dates as D
from tidemark.operators.upsert import Load, current, newest, paths, spread_table
from tidemark.plans import metrics as M
from tidemark.session import written

MAX_PARTS = 60
#: Of each state table the columns that tell rows apart, and how the others go together.
STATE: dict[str, tuple[list[str], dict[str, str]]] = {
    "hours": (
        ["event_time_ymd", "event_time_month", "event_time_day_name", "event_time_hour", "event_type"],
        {"events": "sum", "sessions": "sum", "revenue": "sum"},
    ),
    "brands": (["month", "category_lv_2", "brand"], {"revenue": "sum"}),
    "first_seen": (["user_id"], {"first_time": "min"}),
    "buyers": (["user_id"], {"last": "max", "frequency": "sum", "monetary": "sum"}),
    "newest": ([], {"latest_event_time": "max"}),
    "cohorts": (["cohort_month"], {"users": "sum"}),
    "ret_day": (["cohort_date", "step"], {"users": "sum"}),
    "ret_week": (["cohort_month", "step"], {"users": "sum"}),
    "ret_month": (["cohort_date", "step"], {"users": "sum"}),
}
#: Sets: rows are appended once and never change.
SETS = {"user_days": ["user_id", "day"], "sessions": ["day", "user_session", "bought"]}
SET_SCHEMA = {"user_days": "user_id string, day date, month date", "sessions": "day date, user_session string, bought boolean, month date"}


def _together(df: DataFrame, name: str) -> DataFrame:
    """Increments put together; decimals keep their type, so sums never widen."""
    keys, measures = STATE[name]
    aggs = [getattr(F, f)(c).cast(df.schema[c].dataType).alias(c) for c, f in measures.items()]
    return df.groupBy(*keys).agg(*aggs)


class Store:
    """State and results under a root as one load sees them: what is committed, and its own."""

    def __init__(self, spark: SparkSession, root: str, load: Load | None = None) -> None:
        self.spark, self.root, self.load = spark, root, load

    def raw(self, name: str) -> DataFrame | None:
        if name in SETS:
            return spread_table(self.spark, self.root, f"state_{name}", SET_SCHEMA[name], self.load)
        return current(self.spark, self.root, f"state_{name}", self.load)

    def state(self, name: str) -> DataFrame:
        return _together(self.raw(name), name)

    def months(self, name: str, months: list) -> DataFrame:
        """A set's rows of some months: other folders aren't read."""
        return self.raw(name).filter(F.col("month").isin(months))

    def add(self, name: str, df: DataFrame) -> DataFrame | None:
        """Append increments, and give them back as they were written; or new rows of a set."""
        if name in SETS:
            self.load.spread(df, f"state_{name}", "month")
            return None
        path = self.load.append(df, f"state_{name}")
        if len(paths(self.spark, self.root, f"state_{name}", self.load)) > MAX_PARTS:
            self.load.publish(self.state(name), f"state_{name}")
        return self.spark.read.schema(df.schema).parquet(path)

    def add_all(self, frames: dict[str, DataFrame]) -> dict[str, DataFrame | None]:
        """The same for several tables, side by side."""
        with ThreadPoolExecutor(SIDE_BY_SIDE) as pool:
            return dict(zip(frames, pool.map(lambda n: self.add(n, frames[n]), frames), strict=True))


@dataclass
class Delta:
    """A load's added staging rows and what they touch. Lists are bounded by the calendar."""

    added: DataFrame
    days: list
    months: list
    bins: list
    around: list
    cohort_days: DataFrame
    cohort_months: DataFrame


def _revenue(price: str = "price") -> Column:
    return F.sum(F.when(F.col("event_type") == "purchase", F.round(price, 2).cast("decimal(18,2)")))


def _new_rows(store: Store, name: str, rows: DataFrame, months: list) -> DataFrame:
    """Rows that a set doesn't hold yet; only the touched months are read."""
    keys, old = SETS[name], store.raw(name)
    if old is None:
        return rows
    same = reduce(lambda a, b: a & b, [F.col(f"n.{k}").eqNullSafe(F.col(f"o.{k}")) for k in keys])
    return rows.alias("n").join(store.months(name, months).select(*keys).alias("o"), same, "left_anti")


def _steps(pairs: DataFrame, cohort: Column, step: Column, names: tuple[str, str]) -> DataFrame:
    """Change of users by cohort and step; pairs: user_id, day, sign, first."""
    each = pairs.select("user_id", "sign", cohort.alias(names[0]), step.alias(names[1])).distinct()
    return each.groupBy(*names).agg(F.sum("sign").cast("long").alias("users")).filter("users <> 0")


def _around(months: list[dt.date]) -> list[dt.date]:
    """The months and their neighbours, into which their weeks reach."""
    far = [(m - dt.timedelta(days=1)).replace(day=1) for m in months] + [(m + dt.timedelta(days=32)).replace(day=1) for m in months]
    return sorted({*months, *far})


def _semi(rows: DataFrame, touched: DataFrame, keys: list[str]) -> DataFrame:
    same = reduce(lambda a, b: a & b, [F.col(f"r.{k}").eqNullSafe(F.col(f"t.{k}")) for k in keys])
    return rows.alias("r").join(touched.alias("t"), same, "left_semi")


def take(store: Store, added: DataFrame) -> Delta:
    """Add a load's staging rows to the state. added: a written table of rows that weren't there before."""
    day = F.col("event_time_ymd")
    grain = [*STATE["hours"][0]]
    sums = added.groupBy(*grain).agg(F.count("*").alias("events"), F.count("user_session").alias("sessions"), _revenue().cast("decimal(28,2)").alias("revenue"))
    hours = store.add("hours", sums)
    days = sorted(r[0] for r in hours.select("event_time_ymd").distinct().collect())  # of this load
    months = sorted({d.replace(day=1) for d in days})
    first = dt.date.fromisoformat(D.ANCHOR)
    bins = sorted({d - (d - first) % dt.timedelta(days=7) for d in days})
    around = _around(months)
    bought = M.purchases(added).filter(F.col("category_lv_2") != "unknown")
    visits = added.select(day.alias("day"), "user_session", (F.col("event_type") == "purchase").alias("bought")).distinct()
    store.add_all({
        "brands": bought.groupBy(D.month("event_time").alias("month"), "category_lv_2", "brand").agg(_revenue().cast("decimal(28,2)").alias("revenue")),
        "buyers": M.buyers(added).withColumn("monetary", F.col("monetary").cast("decimal(28,2)")),
        "newest": added.agg(F.max("event_time").alias("latest_event_time")),
        "sessions": _new_rows(store, "sessions", visits, months).withColumn("month", D.month("day")),
    })

    # A user's new days, and what they change in the cohorts.
    active = added.filter("user_id is not null").select("user_id", day.alias("day")).distinct()
    new_days = written(_new_rows(store, "user_days", active, months).withColumn("month", D.month("day")), "new-days")
    firsts = added.groupBy("user_id").agg(F.min("event_time").alias("new_first"))
    known = store.raw("first_seen")
    old_first = _together(known, "first_seen") if known is not None else store.spark.createDataFrame([], "user_id string, first_time timestamp_ntz")
    users = firsts.alias("n").join(old_first.alias("o"), F.col("n.user_id").eqNullSafe(F.col("o.user_id")), "left").select(
        "n.user_id", F.col("o.first_time").alias("was"), F.least("o.first_time", "n.new_first").alias("now")
    )
    users = written(users, "users")  # of this load
    mine = new_days.select("user_id", "day").withColumn("new", F.lit(True))
    history = store.raw("user_days")
    if history is not None:
        # Steps within reach of the new days; of users whose first day is another now, all.
        near = F.col("month").isin(around)
        before = history.filter(near).join(users.select("user_id"), "user_id", "left_semi")
        later = users.filter(D.day("was") != D.day("now")).select("user_id")
        if later.limit(1).count():
            before = before.unionByName(history.filter(~near).join(later, "user_id", "left_semi"))
        mine = mine.unionByName(before.select("user_id", "day").withColumn("new", F.lit(False)))
    signed = F.explode(F.when(F.col("new") | F.col("was").isNull(), F.array(F.struct(F.lit(1).alias("sign"), F.col("now").alias("first")))).otherwise(
        F.array(F.struct(F.lit(1).alias("sign"), F.col("now").alias("first")), F.struct(F.lit(-1).alias("sign"), F.col("was").alias("first")))
    ))
    pairs = written(mine.join(users, "user_id").select("user_id", "day", signed.alias("s")).select("user_id", "day", "s.*"), "cohort-pairs")
    moved = {
        "ret_day": _steps(pairs, D.day("first"), D.day_steps("first", "day"), ("cohort_date", "step")),
        "ret_week": _steps(pairs, D.year_month("first"), D.week_steps("first", "day"), ("cohort_month", "step")),
        "ret_month": _steps(pairs, D.day("first"), D.month_steps("first", "day"), ("cohort_date", "step")),
    }
    sizes = users.select(F.explode(F.array(
        F.struct(F.lit(1).alias("sign"), D.year_month("now").alias("cohort_month")), F.struct(F.lit(-1).alias("sign"), D.year_month("was").alias("cohort_month"))
    )).alias("s")).select("s.*").filter("cohort_month is not null")
    moved["cohorts"] = sizes.groupBy("cohort_month").agg(F.sum("sign").cast("long").alias("users")).filter("users <> 0")
    sets = {"user_days": new_days.select("user_id", "day", "month"), "first_seen": users.select("user_id", F.col("now").alias("first_time"))}
    moved = store.add_all(moved | sets)
    cohort_days = moved["ret_day"].select("cohort_date").union(moved["ret_month"].select("cohort_date")).distinct()
    cohort_months = moved["ret_week"].select("cohort_month").union(moved["cohorts"].select("cohort_month")).distinct()
    return Delta(added, days, months, bins, around, written(cohort_days, "cohort-days"), written(cohort_months, "cohort-months"))


# results ----------------------------------------------------------------------------------


def _hours(store: Store, where: Column | None = None) -> DataFrame:
    df = store.raw("hours")
    return _together(df if where is None else df.filter(where), "hours")


def _month() -> Column:
    return D.month("event_time_ymd")


def _value(c: str = "revenue") -> Column:
    return F.sum(c).cast("double")


def _users(store: Store, d: Delta) -> DataFrame:
    return store.months("user_days", d.around)


def event_type_time_distribution(s: Store, d: Delta) -> DataFrame:
    keys = ["event_time_month", "event_time_day_name", "event_time_hour", "event_type"]
    touched = d.added.select(*keys).distinct()
    rows = _semi(s.raw("hours"), touched, keys)
    return rows.groupBy(*keys).agg(F.sum("sessions").alias("user_session_count"))


def conversion_rate(s: Store, d: Delta) -> DataFrame:
    n = lambda k: F.coalesce(F.sum(F.when(F.col("event_type") == k, F.col("events"))), F.lit(0))
    by = _hours(s, F.col("event_time_ymd").isin(d.days)).groupBy("event_time_ymd").agg(n("purchase").alias("purchase_count"), n("view").alias("view_count"))
    rate = F.col("purchase_count").cast("double") / F.nullif("view_count", F.lit(0))
    return by.withColumn("conversion_rate_percentage", F.round(rate, 4))


def funnel(s: Store, d: Delta) -> DataFrame:
    by = _hours(s, _month().isin(d.months)).groupBy(_month().alias("month"), "event_type")
    return by.agg(F.sum(F.when(F.col("event_type").isNotNull(), F.col("events")).otherwise(0)).alias("cnt"))


def price_distribution(s: Store, d: Delta) -> DataFrame:
    rows = _hours(s, _month().isin(d.months)).filter("event_type = 'purchase'")
    by = rows.groupBy(D.year_month("event_time_ymd").alias("event_time_month"), "event_time_day_name", "event_time_hour", "event_type")
    return by.agg(_value().alias("hourly_price"))


def monthly_price_event_type(s: Store, d: Delta) -> DataFrame:
    counts = funnel(s, d).withColumnRenamed("cnt", "event_type_count")
    paid = _hours(s, _month().isin(d.months)).groupBy(_month().alias("month")).agg(_value().alias("sum_price"))
    return counts.join(paid, "month").select("month", "event_type", "event_type_count", "sum_price")


def purchased_order(s: Store, d: Delta) -> DataFrame:
    """Days; reading adds the total."""
    paid = _hours(s, F.col("event_time_ymd").isin(d.days) & (F.col("event_type") == "purchase")).groupBy("event_time_ymd").agg(F.sum("revenue").cast("decimal(28,2)").alias("daily"))
    bought = s.months("sessions", d.months).filter(F.col("day").isin(d.days) & F.col("bought")).groupBy(F.col("day").alias("event_time_ymd"))
    return paid.join(bought.agg(F.countDistinct("user_session").alias("session_purchase_count")), "event_time_ymd")


def count_visitors(s: Store, d: Delta) -> DataFrame:
    rows = s.months("sessions", d.months).filter(F.col("day").isin(d.days))
    return rows.groupBy(F.col("day").alias("event_time_ymd")).agg(F.countDistinct("user_session").alias("user_session_count"))


def dau(s: Store, d: Delta) -> DataFrame:
    rows = s.months("user_days", d.months).filter(F.col("day").isin(d.days))
    found = rows.groupBy(F.col("day").alias("event_date")).agg(F.count("*").alias("dau"))
    return _whole(s, d.days, found, "dau")


def wau(s: Store, d: Delta, anchor: str = D.ANCHOR) -> DataFrame:
    week = D.bin_start("day", anchor)
    found = _users(s, d).filter(week.isin(d.bins)).groupBy(week.alias("event_date")).agg(F.countDistinct("user_id").alias("wau"))
    return _whole(s, d.bins, found, "wau")


def mau(s: Store, d: Delta) -> DataFrame:
    found = s.months("user_days", d.months).groupBy(F.col("month").alias("event_date")).agg(F.countDistinct("user_id").alias("mau"))
    return _whole(s, d.months, found, "mau")


def _whole(s: Store, dates: list, found: DataFrame, name: str) -> DataFrame:
    """Dates whose events have no user count none."""
    frame = s.spark.createDataFrame([(x,) for x in dates], "event_date date")
    return frame.join(found, "event_date", "left").withColumn(name, F.coalesce(name, F.lit(0)).cast("long"))


def stickiness(s: Store, d: Delta) -> DataFrame:
    daily = read(s, "dau").filter(D.month("event_date").isin(d.months)).groupBy(D.month("event_date").alias("event_date")).agg(F.avg("dau").alias("mean"))
    monthly = read(s, "mau").filter(F.col("event_date").isin(d.months))
    return daily.join(monthly, "event_date").select("event_date", (F.col("mean") / F.nullif("mau", F.lit(0))).alias("stickiness"))


def active_users(s: Store, d: Delta) -> DataFrame:
    """Days touched, and the days that begin a touched week or month."""
    mine = lambda name: read(s, name).filter(F.col("event_date").isin(sorted({*d.days, *d.bins, *d.months})))
    return mine("dau").join(mine("wau"), "event_date", "left").join(mine("mau"), "event_date", "left")


def stickiness_mau(s: Store, d: Delta) -> DataFrame:
    return read(s, "mau").filter(F.col("event_date").isin(d.months)).join(read(s, "stickiness"), "event_date")


def retention_daily(s: Store, d: Delta) -> DataFrame:
    rows = s.raw("ret_day").join(d.cohort_days, "cohort_date", "left_semi")
    return _together(rows, "ret_day").filter("users > 0").toDF("cohort_date", "day_diff", "retained_users")


def retention_monthly(s: Store, d: Delta) -> DataFrame:
    rows = s.raw("ret_month").join(d.cohort_days, "cohort_date", "left_semi")
    return _together(rows, "ret_month").filter("users > 0").toDF("cohort_date", "month_diff", "retained_users")


def retention_monthly_rate(s: Store, d: Delta) -> DataFrame:
    months = d.cohort_days.select(D.month("cohort_date").alias("cohort_month")).distinct()
    rows = s.state("ret_month").filter("users > 0").withColumn("cohort_month", D.month("cohort_date")).join(months, "cohort_month", "left_semi")
    by = rows.groupBy("cohort_month", F.col("step").alias("month_diff")).agg(F.sum("users").alias("retained_users"))
    return M.monthly_rate(by)


def retention_weekly(s: Store, d: Delta, weeks: int = 4) -> DataFrame:
    rows = s.raw("ret_week").join(d.cohort_months, "cohort_month", "left_semi")
    active = _together(rows, "ret_week").filter("users > 0").filter(F.col("step").between(0, weeks)).toDF("cohort_month", "week_number", "active_users")
    sizes = s.state("cohorts").toDF("cohort_month", "cohort_size")
    return M.weekly_rate(active, sizes)


def category_lv2_top(s: Store, d: Delta, n: int = 10) -> DataFrame:
    rows = _together(s.raw("brands").filter(F.col("month").isin(d.months)), "brands")
    return M.top_by_month(rows.withColumn("sum_price", F.col("revenue").cast("double")).drop("revenue"), n)


Result = Callable[[Store, Delta], DataFrame]
#: Each result's units: rows of a unit are replaced together.
RESULTS: dict[str, tuple[Result, list[str]]] = {
    "event_type_time_distribution": (event_type_time_distribution, ["event_time_month", "event_time_day_name", "event_time_hour", "event_type"]),
    "conversion_rate": (conversion_rate, ["event_time_ymd"]),
    "funnel": (funnel, ["month"]),
    "price_distribution": (price_distribution, ["event_time_month"]),
    "monthly_price_event_type": (monthly_price_event_type, ["month"]),
    "purchased_order": (purchased_order, ["event_time_ymd"]),
    "count_visitors": (count_visitors, ["event_time_ymd"]),
    "dau": (dau, ["event_date"]),
    "wau": (wau, ["event_date"]),
    "mau": (mau, ["event_date"]),
    "stickiness": (stickiness, ["event_date"]),
    "active_users": (active_users, ["event_date"]),
    "stickiness_mau": (stickiness_mau, ["event_date"]),
    "retention_daily": (retention_daily, ["cohort_date"]),
    "retention_monthly": (retention_monthly, ["cohort_date"]),
    "retention_monthly_rate": (retention_monthly_rate, ["cohort_month"]),
    "retention_weekly": (retention_weekly, ["cohort_month"]),
    "category_lv2_top": (category_lv2_top, ["month"]),
}
#: Results that read results of earlier waves.
LATER = (("stickiness", "active_users"), ("stickiness_mau",))
SIDE_BY_SIDE = 8
#: Published as a whole.
WHOLE = ("rfm_combined", "latest_date")


def _gone(name: str, d: Delta) -> DataFrame | None:
    """Units a load touches that may have lost all rows."""
    if name in ("retention_daily", "retention_monthly"):
        return d.cohort_days
    if name == "retention_weekly":
        return d.cohort_months
    if name == "retention_monthly_rate":
        return d.cohort_days.select(D.month("cohort_date").alias("cohort_month")).distinct()
    return None


def _publish(store: Store, d: Delta, name: str) -> int:
    """Write a result's touched units; how many rows that were."""
    f, unit = RESULTS[name]
    rows, touched = f(store, d).withColumn("__gone", F.lit(False)), _gone(name, d)
    if touched is not None:
        empty = touched.join(rows.select(*unit), unit, "left_anti").withColumn("__gone", F.lit(True))
        rows = rows.unionByName(empty, allowMissingColumns=True)
    seen = Observation(name)
    store.load.replace(rows.observe(seen, F.count(F.lit(1)).alias("rows")), name, unit)
    found = paths(store.spark, store.root, name, store.load)
    if len(found) > MAX_PARTS:
        store.load.publish(newest(store.spark.read.parquet(*found)), name)
    return seen.get["rows"]


def _publish_whole(store: Store) -> dict[str, int]:
    buyers = written(store.state("buyers"), "buyers")
    scored = M.rfm_of(buyers, store.state("newest").select(F.col("latest_event_time").alias("newest")))
    wrote = {}
    for name, df in (("rfm_combined", M.combined(scored)), ("latest_date", store.state("newest"))):
        seen = Observation(name)
        store.load.publish(df.observe(seen, F.count(F.lit(1)).alias("rows")), name)
        wrote[name] = seen.get["rows"]
    return wrote


def refresh(store: Store, added: DataFrame) -> dict[str, int]:
    """Bring state and results up to a load's added staging rows; result rows written, by table.

    Results are small jobs that don't depend on each other, but for those in LATER, so they run side
    by side.
    """
    d = take(store, added)
    wrote: dict[str, int] = {}
    waves = [[n for n in RESULTS if n not in sum(LATER, ())], *LATER] if d.days else []
    with ThreadPoolExecutor(SIDE_BY_SIDE) as pool:
        whole = pool.submit(_publish_whole, store)
        for wave in waves:
            wrote |= dict(zip(wave, pool.map(lambda n: _publish(store, d, n), wave), strict=True))
        return wrote | whole.result()


def read(store: Store, name: str) -> DataFrame | None:
    """A result table as it stands."""
    df = current(store.spark, store.root, name, store.load)
    return M.with_total(df) if df is not None and name == "purchased_order" else df
