"""Metrics over the staging table. Each is lazy, but for the RFM scores, which write their users: f(staging, ...) -> DataFrame.

Money adds prices as decimals rounded to cents, so sums don't depend on the order of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import dates as D
from tidemark.operators.rank import ntile, positions
from tidemark.session import written


#: Least total of a value tier, and names of tiers and customer segments.
HIGH_FROM, MID_FROM = 12, 8
HIGH, MID, LOW = "High-Value", "Mid-Value", "Low-Value"
INACTIVE, AT_RISK, VIP = "Inactive Customer", "At-Risk Customer", "VIP Customer"
LOYAL, CORE = "Potential Loyalist", "Core Customer"


def money(price: Column | str = "price") -> Column:
    c = F.col(price) if isinstance(price, str) else price
    return F.sum(F.round(c, 2).cast("decimal(18,2)")).cast("double")


def _ratio(a: Column, b: Column) -> Column:
    return a.cast("double") / F.nullif(b, F.lit(0))


def purchases(ev: DataFrame) -> DataFrame:
    return ev.filter(F.col("event_type") == "purchase")


# activity
def dau(ev: DataFrame) -> DataFrame:
    return ev.groupBy(D.day("event_time").alias("event_date")).agg(F.countDistinct("user_id").alias("dau"))


def wau(ev: DataFrame, anchor: str = D.ANCHOR) -> DataFrame:
    return ev.groupBy(D.bin_start("event_time", anchor).alias("event_date")).agg(F.countDistinct("user_id").alias("wau"))


def wau_iso(ev: DataFrame) -> DataFrame:
    return ev.groupBy(D.week("event_time").alias("event_date")).agg(F.countDistinct("user_id").alias("wau"))


def mau(ev: DataFrame) -> DataFrame:
    return ev.groupBy(D.month("event_time").alias("event_date")).agg(F.countDistinct("user_id").alias("mau"))


def stickiness(ev: DataFrame) -> DataFrame:
    """Mean of the daily users over days with events, by the month's users."""
    daily = dau(ev).groupBy(D.month("event_date").alias("event_date")).agg(F.avg("dau").alias("mean"))
    return daily.join(mau(ev), "event_date").select("event_date", _ratio(F.col("mean"), F.col("mau")).alias("stickiness"))


def grains(ev: DataFrame, week: Column) -> DataFrame:
    """grain (day, week, month), event_date and users, from one scan: events shrink to (day, user), and
    each of these to its day, week and month."""
    days = ev.select(D.day("event_time").alias("day"), "user_id", week.alias("week")).distinct()
    bins = F.array(*[F.struct(F.lit(g).alias("grain"), c.alias("event_date")) for g, c in (("day", F.col("day")), ("week", F.col("week")), ("month", D.month("day")))])
    pairs = days.select(F.explode(bins).alias("b"), "user_id").select("b.*", "user_id").distinct()
    return pairs.groupBy("grain", "event_date").agg(F.count("user_id").alias("users"))


def _by_date(counts: DataFrame) -> DataFrame:
    pick = lambda g, name: F.max(F.when(F.col("grain") == g, F.col("users"))).alias(name)
    return counts.groupBy("event_date").agg(pick("day", "dau"), pick("week", "wau"), pick("month", "mau"))


def active_users(ev: DataFrame, anchor: str = D.ANCHOR) -> DataFrame:
    """Each day with users, and the week's and month's users on the day that begins it."""
    return _by_date(grains(ev, D.bin_start("event_time", anchor))).filter("dau is not null")


def active_users_full(ev: DataFrame) -> DataFrame:
    """The same with calendar weeks, and with a row for each date that begins a week or month."""
    return _by_date(grains(ev, D.week("event_time")))


def stickiness_mau(ev: DataFrame) -> DataFrame:
    return mau(ev).join(stickiness(ev), "event_date")


def count_visitors(ev: DataFrame) -> DataFrame:
    return ev.groupBy(D.day("event_time").alias("event_time_ymd")).agg(F.countDistinct("user_session").alias("user_session_count"))


# retention
def _first(ev: DataFrame) -> DataFrame:
    return ev.groupBy("user_id").agg(F.min("event_time").alias("first_time"))


def _since(ev: DataFrame, unit: Column) -> DataFrame:
    """user_id, first_time and the distinct units in which the user had events.

    Events shrink to (user, day) before the join, so it moves far fewer rows.
    """
    days = ev.select("user_id", D.day("event_time").alias("day")).distinct()
    return days.join(_first(ev), "user_id").select("user_id", "first_time", unit.alias("step")).distinct()


def retention_daily(ev: DataFrame) -> DataFrame:
    steps = _since(ev, D.day_steps("first_time", "day"))
    return steps.groupBy(D.day("first_time").alias("cohort_date"), F.col("step").alias("day_diff")).agg(F.count("*").alias("retained_users"))


def retention_weekly(ev: DataFrame, weeks: int | None = 4) -> DataFrame:
    """Share of a month's new users active in week 0, 1, ...; weeks=None: without an end."""
    cohort = D.year_month("first_time")
    steps = _since(ev, D.week_steps("first_time", "day"))
    if weeks is not None:
        steps = steps.filter(F.col("step").between(0, weeks))
    active = steps.groupBy(cohort.alias("cohort_month"), F.col("step").alias("week_number")).agg(F.count("*").alias("active_users"))
    return weekly_rate(active, _first(ev).groupBy(cohort.alias("cohort_month")).agg(F.count("*").alias("cohort_size")))


def weekly_rate(active: DataFrame, sizes: DataFrame) -> DataFrame:
    pct = F.round(_ratio(F.col("active_users") * 100, F.col("cohort_size")), 2)
    return active.join(sizes, "cohort_month").withColumn("retention_rate_percentage", pct)


def retention_monthly(ev: DataFrame) -> DataFrame:
    steps = _since(ev, D.month_steps("first_time", "day"))
    return steps.groupBy(D.day("first_time").alias("cohort_date"), F.col("step").alias("month_diff")).agg(F.count("*").alias("retained_users"))


def retention_monthly_rate(ev: DataFrame) -> DataFrame:
    by = retention_monthly(ev).groupBy(D.month("cohort_date").alias("cohort_month"), "month_diff").agg(F.sum("retained_users").alias("retained_users"))
    return monthly_rate(by)


def monthly_rate(by: DataFrame) -> DataFrame:
    base = F.max(F.when(F.col("month_diff") == 0, F.col("retained_users"))).over(Window.partitionBy("cohort_month"))
    return by.withColumn("base", base).filter("base is not null").select(
        "cohort_month",
        F.concat(F.lit("Month "), F.col("month_diff").cast("string")).alias("month_label"),
        "retained_users",
        F.round(_ratio(F.col("retained_users"), F.col("base")), 3).alias("retention_rate_pct"),
    )


# RFM
def buyers(ev: DataFrame) -> DataFrame:
    """user_id, last purchase, frequency and monetary (in cents' decimals) of purchasing users."""
    paid = F.sum(F.round("price", 2).cast("decimal(18,2)"))
    return purchases(ev).groupBy("user_id").agg(F.max("event_time").alias("last"), F.count("*").alias("frequency"), paid.alias("monetary"))


def rfm(ev: DataFrame) -> DataFrame:
    """Scores 1..5 of purchasing users. Ties go by user_id.

    Users with their purchases and the newest event of all come from one read and are written once,
    then each key is ranked by one range shuffle of the users (see operators.rank).
    """
    bought = F.col("event_type") == "purchase"
    users = ev.groupBy("user_id").agg(
        F.max("event_time").alias("seen"), F.max(F.when(bought, F.col("event_time"))).alias("last"), F.count_if(bought).alias("frequency"),
        F.sum(F.when(bought, F.round("price", 2).cast("decimal(18,2)"))).alias("monetary"),
    )
    users = written(users, "users")
    return rfm_of(users.filter("last is not null"), users.agg(F.max("seen").alias("newest")))


def rfm_of(users: DataFrame, newest: DataFrame) -> DataFrame:
    """The scores of a written table as ``buyers`` gives it; newest: one row, the time of the newest event."""
    base = users.crossJoin(F.broadcast(newest)).select(
        "user_id", D.day_steps("last", "newest").alias("recency"), "frequency", F.col("monetary").cast("double").alias("monetary")
    )
    scored, n = base, F.lit(users.count())
    for name, key in {"recency": F.col("recency"), "frequency": -F.col("frequency"), "monetary": -F.col("monetary")}.items():
        ranked = positions(scored.withColumn("__key", key), ["__key", "user_id"], "__position", settled=True)
        scored = ranked.withColumn(f"{name}_score", (6 - ntile(F.col("__position"), n)).cast("long")).drop("__key", "__position")
    total = F.col("recency_score") + F.col("frequency_score") + F.col("monetary_score")
    r, f, m = (F.col(f"{n}_score") for n in ("recency", "frequency", "monetary"))
    all_at = lambda k: (r >= k) & (f >= k) & (m >= k)
    return scored.withColumns({
        "rfm_total": total,
        "rfm_value_segment": F.when(total >= HIGH_FROM, HIGH).when(total >= MID_FROM, MID).otherwise(LOW),
        "customer_segment": F.when(r == 1, INACTIVE).when(r == 2, AT_RISK).when(all_at(4), VIP).when(all_at(3), LOYAL).otherwise(CORE),
    })


def rfm_combined(ev: DataFrame) -> DataFrame:
    return combined(rfm(ev))


def combined(scored: DataFrame) -> DataFrame:
    return scored.withColumn("combined_segment", F.concat("rfm_value_segment", F.lit(" - "), "customer_segment"))


# funnel and conversion
def event_type_time_distribution(ev: DataFrame) -> DataFrame:
    keys = ["event_time_month", "event_time_day_name", "event_time_hour", "event_type"]
    return ev.groupBy(*keys).agg(F.count("user_session").alias("user_session_count"))


def conversion_rate(ev: DataFrame) -> DataFrame:
    n = {k: F.count_if(F.col("event_type") == k) for k in ("purchase", "view")}
    return ev.groupBy(D.day("event_time").alias("event_time_ymd")).agg(
        n["purchase"].alias("purchase_count"), n["view"].alias("view_count"),
        F.round(_ratio(n["purchase"], n["view"]), 4).alias("conversion_rate_percentage"),
    )


def funnel(ev: DataFrame) -> DataFrame:
    return ev.groupBy(D.month("event_time").alias("month"), "event_type").agg(F.count("event_type").alias("cnt"))


def conversion_funnel(ev: DataFrame) -> DataFrame:
    n = {k: F.count_if(F.col("event_type") == k) for k in ("view", "cart", "purchase")}
    sums = ev.groupBy(D.day("event_time").alias("event_date")).agg(*[c.alias(f"{k}s") for k, c in n.items()])
    rate = lambda a, b: F.round(_ratio(F.col(a) * 100, F.col(b)), 2)
    return sums.withColumns({
        "view_to_cart_rate": rate("carts", "views"), "cart_to_purchase_rate": rate("purchases", "carts"),
        "view_to_purchase_rate": rate("purchases", "views"),
    })


# revenue
def purchased_order(ev: DataFrame) -> DataFrame:
    daily = purchases(ev).groupBy(D.day("event_time").alias("event_time_ymd")).agg(
        F.sum(F.round("price", 2).cast("decimal(18,2)")).alias("daily"), F.countDistinct("user_session").alias("session_purchase_count")
    )
    return with_total(daily)


def with_total(days: DataFrame) -> DataFrame:
    total = F.sum("daily").over(Window.partitionBy())  # over days
    return days.select("event_time_ymd", F.col("daily").cast("double").alias("daily_price"), total.cast("double").alias("total_price"), "session_purchase_count")


def price_distribution(ev: DataFrame) -> DataFrame:
    month = D.year_month("event_time").alias("event_time_month")
    return purchases(ev).groupBy(month, "event_time_day_name", "event_time_hour", "event_type").agg(money().alias("hourly_price"))


def monthly_price_event_type(ev: DataFrame) -> DataFrame:
    """Counts by month and type, and the month's revenue on each: one pass over events."""
    paid = F.sum(F.when(F.col("event_type") == "purchase", F.round("price", 2).cast("decimal(18,2)")))
    by = ev.groupBy(D.month("event_time").alias("month"), "event_type").agg(F.count("event_type").alias("event_type_count"), paid.alias("paid"))
    return by.select("month", "event_type", "event_type_count", F.max("paid").over(Window.partitionBy("month")).cast("double").alias("sum_price"))


def latest_date(ev: DataFrame) -> DataFrame:
    return ev.agg(F.max("event_time").alias("latest_event_time"))


def category_lv2_top(ev: DataFrame, n: int = 10) -> DataFrame:
    sums = purchases(ev).filter(F.col("category_lv_2") != "unknown").groupBy(
        D.month("event_time").alias("month"), "category_lv_2", "brand"
    ).agg(money().alias("sum_price"))
    return top_by_month(sums, n)


def top_by_month(sums: DataFrame, n: int) -> DataFrame:
    order = Window.partitionBy("month").orderBy(F.desc("sum_price"), "category_lv_2", "brand")
    return sums.withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= n).drop("rn")


# documented reports
def events_by_hour(ev: DataFrame) -> DataFrame:
    return ev.groupBy("event_time_hour").agg(F.count("*").alias("cnt"))


def events_by_day_type(ev: DataFrame) -> DataFrame:
    return ev.groupBy(D.day("event_time").alias("event_date"), "event_type").agg(F.count("*").alias("cnt"))


def category_revenue(ev: DataFrame, *levels: str) -> DataFrame:
    """Purchases by category levels: distinct products and customers, revenue, mean price."""
    return purchases(ev).groupBy(*levels).agg(
        F.countDistinct("product_id").alias("products"), F.countDistinct("user_id").alias("customers"), money().alias("revenue"),
        F.round(_ratio(money(), F.count("price")), 4).alias("mean_price"),
    )


def brand_price_stats(products: DataFrame) -> DataFrame:
    return products.groupBy("brand").agg(
        F.countDistinct("product_id").alias("products"), F.round(_ratio(money(), F.count("price")), 4).alias("mean_price"),
        F.min("price").alias("min_price"), F.max("price").alias("max_price"),
    )


def top_users(ev: DataFrame, n: int = 10) -> DataFrame:
    by = ev.groupBy("user_id").agg(F.countDistinct("user_session").alias("sessions"), F.count("*").alias("events"))
    return by.orderBy(F.desc("events"), "user_id").limit(n)


def daily_summary(ev: DataFrame) -> DataFrame:
    return ev.groupBy(D.day("event_time").alias("event_date")).agg(
        F.count("*").alias("events"), F.countDistinct("user_id").alias("users"), F.countDistinct("product_id").alias("products")
    )
