"""Named queries on the test tables, and the SQL each is held against."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import clean as C
from tidemark.functions import dates as D
from tidemark.operators import bitmaps, buckets, quality, star, upsert
from tidemark.plans import metrics as M
from tidemark.plans import pipeline
from tidemark.plans.sql import run_block
from tidemark.plans.weeks import week_frame
from tidemark.schema import RAW, RAW_COLUMNS, STAR, reset_tables
from tidemark.session import shared_path, written
from tidemark.sources import events as E
from tidemark.sources import rejects
from tidemark.sources.fixtures import fx_events, fx_orders, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
ANCHOR = "2024-01-01"
CUT = "2024-01-22"

# SQL building blocks -------------------------------------------------------------------

_FX = """fx AS (SELECT CAST(e.user_id AS VARCHAR) AS user_id, CAST(e.user_id AS VARCHAR) || '-' || strftime(e.ts, '%Y%m%d') AS user_session,
 p.p_type AS category_id, date_trunc('second', e.ts) AS event_time, e.event_type, CAST(p.p_partkey AS VARCHAR) AS product_id,
 CASE WHEN p.p_type = 'PROMO' OR e.event_id % 7 = 0 THEN NULL WHEN p.p_size % 3 = 0 THEN lower(p.p_type) || '.' || string_split(p.p_name, ' ')[1]
      ELSE lower(p.p_type) || '.' || replace(p.p_name, ' ', '.') END AS category_code,
 CASE WHEN p.p_partkey % 11 = 0 OR e.event_id % 5 = 0 THEN NULL ELSE lower(p.p_brand) END AS brand,
 CASE WHEN e.event_id % 10 = 0 THEN round(p.p_retailprice * 0.9, 2) ELSE p.p_retailprice END AS price
 FROM events e JOIN part p ON CAST(json_extract_string(e.props, '$.k') AS BIGINT) = p.p_partkey)"""

_EV = f"""{_FX},
ev AS (SELECT *, CAST(event_time AS DATE) AS event_time_ymd, strftime(event_time, '%H:%M:%S') AS event_time_hms, strftime(event_time, '%m') AS event_time_month,
 strftime(event_time, '%d') AS event_time_day, strftime(event_time, '%H') AS event_time_hour, strftime(event_time, '%a') AS event_time_day_name,
 DATE '{ANCHOR}' + CAST(floor((CAST(event_time AS DATE) - DATE '{ANCHOR}') / 7.0) * 7 AS INTEGER) AS week_start FROM fx)"""


def _impute_sql(n: int, group: str, target: str, scope: str = "week_start, ") -> str:
    using = f"p.week_start = m.week_start AND p.{group} = m.{group}" if scope else f"p.{group} = m.{group}"
    return f"""m{n} AS (SELECT {scope}{group}, {target} AS v FROM (SELECT {scope}{group}, {target},
 row_number() OVER (PARTITION BY {scope}{group} ORDER BY count(*) DESC, {target}) AS rn FROM i{n - 1} WHERE {target} IS NOT NULL
 GROUP BY {scope}{group}, {target}) WHERE rn = 1),
i{n} AS (SELECT p.* REPLACE (coalesce(p.{target}, m.v) AS {target}) FROM i{n - 1} p LEFT JOIN m{n} m ON {using})"""


_CLEAN = f"""{_EV}, i0 AS (SELECT * FROM ev),
{", ".join(_impute_sql(n, g, t) for n, (g, t) in enumerate(C.IMPUTE_STEPS, 1))},
u AS (SELECT * REPLACE (coalesce(category_code, 'unknown') AS category_code, coalesce(brand, 'unknown') AS brand) FROM i4),
clean AS (SELECT *, CASE WHEN category_code = 'unknown' THEN 'unknown' ELSE string_split(category_code, '.')[1] END AS category_lv_1,
 CASE WHEN category_code = 'unknown' THEN 'unknown' ELSE coalesce(string_split(category_code, '.')[2], 'none') END AS category_lv_2,
 CASE WHEN category_code = 'unknown' THEN 'unknown' ELSE coalesce(string_split(category_code, '.')[3], 'none') END AS category_lv_3 FROM u)"""

_MODE = """(SELECT product_id, {0} FROM (SELECT product_id, {0}, row_number() OVER (PARTITION BY product_id ORDER BY count(*) DESC, max(event_time) DESC, {0} NULLS FIRST) AS rn
 FROM clean GROUP BY product_id, {0}) WHERE rn = 1)"""

_STAR = f"""{_CLEAN},
category_dim AS (SELECT category_id, category_code, category_lv_1, category_lv_2, category_lv_3 FROM (SELECT category_id, category_code, category_lv_1, category_lv_2, category_lv_3,
 row_number() OVER (PARTITION BY category_id ORDER BY count(*) DESC, category_code) AS rn FROM clean GROUP BY category_id, category_code, category_lv_1, category_lv_2, category_lv_3) WHERE rn = 1),
product_dim AS (SELECT b.product_id, b.brand, p.price FROM {_MODE.format("brand")} b JOIN {_MODE.format("price")} p USING (product_id)),
st AS (SELECT c.user_id, c.user_session, c.category_id, c.product_id, c.event_type, c.event_time, c.event_time_ymd, c.event_time_hms, c.event_time_month, c.event_time_day,
 c.event_time_hour, c.event_time_day_name, d.category_code, d.category_lv_1, d.category_lv_2, d.category_lv_3, p.brand, p.price
 FROM clean c LEFT JOIN category_dim d USING (category_id) LEFT JOIN product_dim p USING (product_id))"""

_FXO = """ev AS (SELECT CAST(o.o_custkey AS VARCHAR) AS user_id, CAST(o.o_orderkey AS VARCHAR) AS user_session, CAST(o.o_orderdate AS TIMESTAMP) AS event_time,
 'purchase' AS event_type, CAST(l.l_partkey AS VARCHAR) AS product_id, l.l_extendedprice AS price, lower(p.p_type) AS category_lv_2, lower(p.p_brand) AS brand
 FROM orders o JOIN lineitem l ON l.l_orderkey = o.o_orderkey JOIN part p ON p.p_partkey = l.l_partkey)"""

_DAY = "CAST(event_time AS DATE)"
_MONTH = "CAST(date_trunc('month', event_time) AS DATE)"
_WEEK = "CAST(date_trunc('week', event_time) AS DATE)"
_BIN = f"DATE '{D.ANCHOR}' + CAST(floor(({_DAY} - DATE '{D.ANCHOR}') / 7.0) * 7 AS INTEGER)"
_MONEY = "CAST(sum(CAST(round(price, 2) AS DECIMAL(18,2))) AS DOUBLE)"
_DAU = f"SELECT {_DAY} AS event_date, count(DISTINCT user_id) AS dau FROM ev GROUP BY 1"
_WAU = f"SELECT {_BIN} AS event_date, count(DISTINCT user_id) AS wau FROM ev GROUP BY 1"
_WAU_ISO = f"SELECT {_WEEK} AS event_date, count(DISTINCT user_id) AS wau FROM ev GROUP BY 1"
_MAU = f"SELECT {_MONTH} AS event_date, count(DISTINCT user_id) AS mau FROM ev GROUP BY 1"
_STICK = f"""SELECT m.event_date, d.mean / m.mau AS stickiness FROM ({_MAU}) m
JOIN (SELECT CAST(date_trunc('month', event_date) AS DATE) AS event_date, avg(dau) AS mean FROM ({_DAU}) GROUP BY 1) d USING (event_date)"""
_FIRST = "first AS (SELECT user_id, min(event_time) AS f FROM ev GROUP BY 1)"
_RET_D = f"""SELECT CAST(f AS DATE) AS cohort_date, CAST({_DAY} - CAST(f AS DATE) AS BIGINT) AS day_diff, count(DISTINCT user_id) AS retained_users
FROM ev JOIN first USING (user_id) GROUP BY 1, 2"""
_WDIFF = "CAST((CAST(date_trunc('week', event_time) AS DATE) - CAST(date_trunc('week', f) AS DATE)) // 7 AS BIGINT)"
_RET_W = f"""SELECT cohort_month, week_number, active_users, cohort_size, round(active_users * 100.0::DOUBLE / cohort_size, 2) AS retention_rate_percentage
FROM (SELECT strftime(f, '%Y-%m') AS cohort_month, {_WDIFF} AS week_number, count(DISTINCT user_id) AS active_users FROM ev JOIN first USING (user_id) GROUP BY 1, 2)
JOIN (SELECT strftime(f, '%Y-%m') AS cohort_month, count(*) AS cohort_size FROM first GROUP BY 1) USING (cohort_month)"""
_MDIFF = "CAST((year(event_time) - year(f)) * 12 + month(event_time) - month(f) AS BIGINT)"
_RET_M = f"""SELECT CAST(f AS DATE) AS cohort_date, {_MDIFF} AS month_diff, count(DISTINCT user_id) AS retained_users FROM ev JOIN first USING (user_id) GROUP BY 1, 2"""
_RET_R = f"""SELECT cohort_month, 'Month ' || month_diff AS month_label, n AS retained_users, round(n::DOUBLE / base, 3) AS retention_rate_pct
FROM (SELECT *, max(CASE WHEN month_diff = 0 THEN n END) OVER (PARTITION BY cohort_month) AS base
 FROM (SELECT CAST(date_trunc('month', cohort_date) AS DATE) AS cohort_month, month_diff, CAST(sum(retained_users) AS BIGINT) AS n FROM ({_RET_M}) GROUP BY 1, 2)) WHERE base IS NOT NULL"""
_RFM = f"""SELECT *, CASE WHEN rfm_total >= 12 THEN 'High-Value' WHEN rfm_total >= 8 THEN 'Mid-Value' ELSE 'Low-Value' END AS rfm_value_segment,
 CASE WHEN recency_score = 1 THEN 'Inactive Customer' WHEN recency_score = 2 THEN 'At-Risk Customer' WHEN least(recency_score, frequency_score, monetary_score) >= 4 THEN 'VIP Customer'
  WHEN least(recency_score, frequency_score, monetary_score) >= 3 THEN 'Potential Loyalist' ELSE 'Core Customer' END AS customer_segment
FROM (SELECT *, recency_score + frequency_score + monetary_score AS rfm_total FROM (SELECT user_id, recency, frequency, monetary,
 6 - ntile(5) OVER (ORDER BY recency, user_id) AS recency_score, 6 - ntile(5) OVER (ORDER BY frequency DESC, user_id) AS frequency_score,
 6 - ntile(5) OVER (ORDER BY monetary DESC, user_id) AS monetary_score
 FROM (SELECT user_id, CAST((SELECT CAST(max(event_time) AS DATE) FROM ev) - CAST(max(event_time) AS DATE) AS BIGINT) AS recency, count(*) AS frequency, {_MONEY} AS monetary
  FROM ev WHERE event_type = 'purchase' GROUP BY 1)))"""
_CONV = f"""SELECT {_DAY} AS event_time_ymd, count(*) FILTER (WHERE event_type = 'purchase') AS purchase_count, count(*) FILTER (WHERE event_type = 'view') AS view_count,
 round(count(*) FILTER (WHERE event_type = 'purchase')::DOUBLE / nullif(count(*) FILTER (WHERE event_type = 'view'), 0), 4) AS conversion_rate_percentage FROM ev GROUP BY 1"""
_ETTD = "SELECT event_time_month, event_time_day_name, event_time_hour, event_type, count(user_session) AS user_session_count FROM ev GROUP BY ALL"
_FUNNEL = f"SELECT {_MONTH} AS month, event_type, count(event_type) AS cnt FROM ev GROUP BY ALL"
_VISIT = f"SELECT {_DAY} AS event_time_ymd, count(DISTINCT user_session) AS user_session_count FROM ev GROUP BY 1"
_ORDERED = f"""SELECT event_time_ymd, CAST(d AS DOUBLE) AS daily_price, CAST(sum(d) OVER () AS DOUBLE) AS total_price, session_purchase_count
FROM (SELECT {_DAY} AS event_time_ymd, sum(CAST(round(price, 2) AS DECIMAL(18,2))) AS d, count(DISTINCT user_session) AS session_purchase_count
 FROM ev WHERE event_type = 'purchase' GROUP BY 1)"""
_PRICE = f"""SELECT strftime(event_time, '%Y-%m') AS event_time_month, event_time_day_name, event_time_hour, event_type, {_MONEY} AS hourly_price
FROM ev WHERE event_type = 'purchase' GROUP BY ALL"""
_MPE = f"""SELECT month, event_type, event_type_count, sum_price FROM (SELECT {_MONTH} AS month, event_type, count(event_type) AS event_type_count FROM ev GROUP BY ALL)
LEFT JOIN (SELECT {_MONTH} AS month, {_MONEY} AS sum_price FROM ev WHERE event_type = 'purchase' GROUP BY 1) USING (month)"""
_LV2 = f"""SELECT month, category_lv_2, brand, sum_price FROM (SELECT *, row_number() OVER (PARTITION BY month ORDER BY sum_price DESC, category_lv_2, brand) AS rn
FROM (SELECT {_MONTH} AS month, category_lv_2, brand, {_MONEY} AS sum_price FROM ev WHERE event_type = 'purchase' AND category_lv_2 <> 'unknown' GROUP BY ALL)) WHERE rn <= 10"""

# Frames ---------------------------------------------------------------------------------


def timed(spark: SparkSession, d: str) -> DataFrame:
    """Fixture events with their time columns. Metrics of users, sessions and types need no
    more: staging has one row for each event, so its lookups would change nothing."""
    return C.time_parts(fx_events(spark, d))


def cleaned(spark: SparkSession, d: str) -> DataFrame:
    return C.clean_events(fx_events(spark, d), ANCHOR)


def staged(spark: SparkSession, d: str) -> DataFrame:
    return star.staged(cleaned(spark, d))


def add(name: str, query: Query, sql: str) -> None:
    QUERIES[name], ORACLE[name] = query, sql


def on_events(name: str, f: Callable[[DataFrame], DataFrame], sql: str) -> None:
    add(name, lambda s, d: f(timed(s, d)), f"WITH {_EV}, {_FIRST} {sql}")


def on_staged(name: str, f: Callable[[DataFrame], DataFrame], sql: str) -> None:
    add(name, lambda s, d: f(staged(s, d)), f"WITH {_STAR.replace('ev AS', 'e0 AS', 1).replace('FROM ev)', 'FROM e0)', 1)}, ev AS (SELECT * FROM st) {sql}")


def on_priced(name: str, f: Callable[[DataFrame], DataFrame], sql: str) -> None:
    """Metrics that need only the price of staging's lookups."""
    on_staged(name, f, sql)
    QUERIES[name] = lambda s, d: f(star.priced(timed(s, d)))


def on_orders(name: str, f: Callable[[DataFrame], DataFrame], sql: str) -> None:
    add(name, lambda s, d: f(fx_orders(s, d)), f"WITH {_FXO}, {_FIRST} {sql}")


# Metrics --------------------------------------------------------------------------------

for _name, _f, _sql in (
    ("conversion_rate", M.conversion_rate, _CONV),
    ("event_type_time_distribution", M.event_type_time_distribution, _ETTD),
    ("dau", M.dau, _DAU),
    ("wau_anchored", M.wau, _WAU),
    ("wau_iso", M.wau_iso, _WAU_ISO),
    ("mau", M.mau, _MAU),
    ("stickiness", M.stickiness, _STICK),
    ("active_users", M.active_users, f"SELECT event_date, dau, wau, mau FROM ({_DAU}) LEFT JOIN ({_WAU}) USING (event_date) LEFT JOIN ({_MAU}) USING (event_date)"),
    ("active_users_full", M.active_users_full, f"SELECT event_date, dau, wau, mau FROM ({_DAU}) FULL JOIN ({_WAU_ISO}) USING (event_date) FULL JOIN ({_MAU}) USING (event_date)"),
    ("stickiness_mau", M.stickiness_mau, f"SELECT event_date, mau, stickiness FROM ({_MAU}) JOIN ({_STICK}) USING (event_date)"),
    ("funnel", M.funnel, _FUNNEL),
    ("count_visitors", M.count_visitors, _VISIT),
    ("retention_daily", M.retention_daily, _RET_D),
    ("retention_weekly", M.retention_weekly, f"SELECT * FROM ({_RET_W}) WHERE week_number BETWEEN 0 AND 4"),
    ("retention_monthly", M.retention_monthly, _RET_M),
    ("retention_monthly_rate", M.retention_monthly_rate, _RET_R),
    ("latest_date", M.latest_date, "SELECT max(event_time) AS latest_event_time FROM ev"),
    ("events_by_hour", M.events_by_hour, "SELECT event_time_hour, count(*) AS cnt FROM ev GROUP BY 1"),
    ("events_by_day_type", M.events_by_day_type, f"SELECT {_DAY} AS event_date, event_type, count(*) AS cnt FROM ev GROUP BY ALL"),
    ("daily_event_summary", M.daily_summary, f"SELECT {_DAY} AS event_date, count(*) AS events, count(DISTINCT user_id) AS users, count(DISTINCT product_id) AS products FROM ev GROUP BY 1"),
    ("top_users", M.top_users, "SELECT user_id, count(DISTINCT user_session) AS sessions, count(*) AS events FROM ev GROUP BY 1 ORDER BY events DESC, user_id LIMIT 10"),
    ("conversion_funnel", M.conversion_funnel, f"""SELECT *, round(carts * 100.0::DOUBLE / nullif(views, 0), 2) AS view_to_cart_rate, round(purchases * 100.0::DOUBLE / nullif(carts, 0), 2) AS cart_to_purchase_rate,
 round(purchases * 100.0::DOUBLE / nullif(views, 0), 2) AS view_to_purchase_rate FROM (SELECT {_DAY} AS event_date, count(*) FILTER (WHERE event_type = 'view') AS views,
 count(*) FILTER (WHERE event_type = 'cart') AS carts, count(*) FILTER (WHERE event_type = 'purchase') AS purchases FROM ev GROUP BY 1)"""),
):
    on_events(_name, _f, _sql)

for _name, _f, _sql in (
    ("rfm_segments", M.rfm, _RFM),
    ("rfm_combined", M.rfm_combined, f"SELECT *, rfm_value_segment || ' - ' || customer_segment AS combined_segment FROM ({_RFM})"),
    ("purchased_order", M.purchased_order, _ORDERED),
    ("price_distribution", M.price_distribution, _PRICE),
    ("monthly_price_event_type", M.monthly_price_event_type, _MPE),
):
    on_priced(_name, _f, _sql)

for _name, _f, _sql in (
    ("category_lv2_top10", M.category_lv2_top, _LV2),
    ("category_lv1_revenue", lambda ev: M.category_revenue(ev, "category_lv_1"), f"SELECT category_lv_1, count(DISTINCT product_id) AS products, count(DISTINCT user_id) AS customers, {_MONEY} AS revenue, round({_MONEY} / count(price), 4) AS mean_price FROM ev WHERE event_type = 'purchase' GROUP BY 1"),
    ("category_revenue", lambda ev: M.category_revenue(ev, "category_lv_1", "category_lv_2"), f"SELECT category_lv_1, category_lv_2, count(DISTINCT product_id) AS products, count(DISTINCT user_id) AS customers, {_MONEY} AS revenue, round({_MONEY} / count(price), 4) AS mean_price FROM ev WHERE event_type = 'purchase' GROUP BY ALL"),
    ("fact_star_join", lambda ev: ev, "SELECT * FROM ev"),
):
    on_staged(_name, _f, _sql)

for _name, _f, _sql in (
    ("orders_retention_daily", M.retention_daily, _RET_D),
    ("orders_retention_weekly", M.retention_weekly, f"SELECT * FROM ({_RET_W}) WHERE week_number BETWEEN 0 AND 4"),
    ("orders_retention_weekly_all", lambda ev: M.retention_weekly(ev, None), _RET_W),
    ("orders_retention_monthly", M.retention_monthly, _RET_M),
    ("orders_retention_monthly_rate", M.retention_monthly_rate, _RET_R),
    ("orders_active_users", M.active_users, f"SELECT event_date, dau, wau, mau FROM ({_DAU}) LEFT JOIN ({_WAU}) USING (event_date) LEFT JOIN ({_MAU}) USING (event_date)"),
    ("orders_stickiness", M.stickiness, _STICK),
    ("orders_rfm", M.rfm, _RFM),
    ("orders_purchased", M.purchased_order, _ORDERED),
    ("orders_category_top10", M.category_lv2_top, _LV2),
    ("orders_monthly_price", M.monthly_price_event_type, _MPE),
):
    on_orders(_name, _f, _sql)

# Cleaning and star ----------------------------------------------------------------------


def _weekly(s: SparkSession, d: str) -> DataFrame:
    return fx_events(s, d).withColumn("week_start", D.bin_start("event_time", ANCHOR))


_COLS = "user_id, user_session, category_id, event_time, event_type, product_id, category_code, brand, price, week_start"
add(
    "impute_category_code",
    lambda s, d: C.impute(_weekly(s, d), C.IMPUTE_STEPS[:2]),
    f"WITH {_EV}, i0 AS (SELECT * FROM ev), {_impute_sql(1, 'product_id', 'category_code')}, {_impute_sql(2, 'category_id', 'category_code')} SELECT {_COLS} FROM i2",
)
add("impute_brand", lambda s, d: C.impute(_weekly(s, d)), f"WITH {_CLEAN} SELECT {_COLS} FROM i4")
add(
    "impute_brand_global",
    lambda s, d: C.impute(_weekly(s, d), [("product_id", "brand"), ("category_id", "brand")], scope=()),
    f"WITH {_EV}, i0 AS (SELECT * FROM ev), {_impute_sql(1, 'product_id', 'brand', '')}, {_impute_sql(2, 'category_id', 'brand', '')} SELECT {_COLS} FROM i2",
)
add(
    "category_levels",
    lambda s, d: cleaned(s, d).select("category_code", "category_lv_1", "category_lv_2", "category_lv_3").distinct(),
    f"WITH {_CLEAN} SELECT DISTINCT category_code, category_lv_1, category_lv_2, category_lv_3 FROM clean",
)
_RAW = "user_id, user_session, category_id, event_time, event_time_ymd, event_time_hms, event_time_month, event_time_day, event_time_hour, event_time_day_name, event_type, product_id, category_code, category_lv_1, category_lv_2, category_lv_3, brand, price"
add("clean_events", cleaned, f"WITH {_CLEAN} SELECT {_RAW} FROM clean")
add("time_parts", lambda s, d: timed(s, d).select("user_id", "event_time", *star.TIME_COLUMNS[1:]), f"WITH {_EV} SELECT user_id, event_time, event_time_ymd, event_time_hms, event_time_month, event_time_day, event_time_hour, event_time_day_name FROM ev")
add(
    "time_dim", lambda s, d: star.time_dim(timed(s, d)).drop("time_id"),
    f"WITH {_EV} SELECT DISTINCT event_time, event_time_ymd, event_time_hms, event_time_month, event_time_day, event_time_hour, event_time_day_name FROM ev",
)
add("category_dim", lambda s, d: star.category_dim(cleaned(s, d)), f"WITH {_STAR} SELECT * FROM category_dim")
add("product_dim", lambda s, d: star.product_dim(cleaned(s, d)), f"WITH {_STAR} SELECT * FROM product_dim")
add("user_dim", lambda s, d: star.user_dim(fx_events(s, d)), f"WITH {_FX} SELECT DISTINCT user_id, user_session FROM fx")
add(
    "fact", lambda s, d: star.fact_rows(fx_events(s, d)).drop("time_id"),
    f"WITH {_FX} SELECT category_id, product_id, user_id, user_session, event_type FROM fx",
)
add("brand_price_stats", lambda s, d: M.brand_price_stats(star.product_dim(cleaned(s, d))), f"""WITH {_STAR} SELECT brand, count(DISTINCT product_id) AS products,
 round({_MONEY} / count(price), 4) AS mean_price, min(price) AS min_price, max(price) AS max_price FROM product_dim GROUP BY 1""")

# Windows and weeks ----------------------------------------------------------------------

add(
    "week_slice", lambda s, d: D.date_slice(timed(s, d), "2024-01-08", "2024-01-14").select("user_id", "event_time", "event_type", "product_id"),
    f"WITH {_EV} SELECT user_id, event_time, event_type, product_id FROM ev WHERE event_time_ymd BETWEEN DATE '2024-01-08' AND DATE '2024-01-14'",
)
add(
    "window_half_open", lambda s, d: fx_events(s, d).filter(D.in_window(F.col("event_time"), "2024-01-08", "2024-01-14")).select("user_id", "event_time"),
    f"WITH {_FX} SELECT user_id, event_time FROM fx WHERE event_time >= TIMESTAMP '2024-01-08' AND event_time < TIMESTAMP '2024-01-15'",
)
add(
    "window_inclusive_midnight", lambda s, d: fx_events(s, d).filter(D.in_window(F.col("event_time"), "2024-01-08", "2024-01-14", True)).select("user_id", "event_time"),
    f"WITH {_FX} SELECT user_id, event_time FROM fx WHERE event_time BETWEEN TIMESTAMP '2024-01-08' AND TIMESTAMP '2024-01-14'",
)
add(
    "missing_weeks", lambda s, d: E.missing_weeks(s, week_frame(s, "2023-12-18", "2024-02-12"), _weekly(s, d)),
    f"WITH {_EV}, w AS (SELECT CAST(range AS DATE) AS week_start, CAST(range AS DATE) + 6 AS week_end FROM range(DATE '2023-12-18', DATE '2024-02-13', INTERVAL 7 DAY)) SELECT * FROM w WHERE week_start NOT IN (SELECT week_start FROM ev)",
)
add(
    "week_partition_counts", lambda s, d: _weekly(s, d).groupBy("week_start").agg(F.count("*").alias("cnt")),
    f"WITH {_EV} SELECT week_start, count(*) AS cnt FROM ev GROUP BY 1",
)
add(
    "union_by_name", lambda s, d: E.union_by_name({"jan": _weekly(s, d).filter("event_time < '2024-01-16'").drop("brand"), "late": _weekly(s, d).filter("event_time >= '2024-01-16'")}).select("source_file", "user_id", "event_time", "brand"),
    f"WITH {_FX} SELECT CASE WHEN event_time < TIMESTAMP '2024-01-16' THEN 'jan' ELSE 'late' END AS source_file, user_id, event_time, CASE WHEN event_time >= TIMESTAMP '2024-01-16' THEN brand END AS brand FROM fx",
)

# Profiles and checks --------------------------------------------------------------------

_NULLS = " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) FILTER (WHERE {c} IS NULL) AS nulls, count(*) AS rows FROM fx" for c in ("user_id", "user_session", "category_id", "event_time", "event_type", "product_id", "category_code", "brand", "price"))
add("null_profile", lambda s, d: quality.null_profile(fx_events(s, d)), f"WITH {_FX} {_NULLS}")
add("shape", lambda s, d: quality.shape(fx_events(s, d)), f"WITH {_FX} SELECT count(*) AS n_rows, CAST(9 AS BIGINT) AS n_columns FROM fx")
add("duplicate_keys", lambda s, d: quality.duplicate_keys(fx_events(s, d), ["event_time"]), f"WITH {_FX} SELECT event_time, count(*) AS cnt FROM fx GROUP BY 1 HAVING count(*) > 1")
add("value_share", lambda s, d: quality.value_share(fx_events(s, d), "brand"), f"WITH {_FX} SELECT brand, count(*) AS cnt, round(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM fx), 2) AS pct FROM fx GROUP BY 1")
add("key_cardinality", lambda s, d: quality.key_cardinality(fx_events(s, d), "category_id", "category_code"), f"WITH {_FX} SELECT category_id, count(DISTINCT coalesce(category_code, 'NULL')) AS n_values FROM fx GROUP BY 1 HAVING count(DISTINCT coalesce(category_code, 'NULL')) > 2")
add("first_fill", lambda s, d: quality.first_fill(fx_events(s, d), "product_id", "brand").select("user_id", "event_time", "product_id", "brand"), f"WITH {_FX} SELECT user_id, event_time, product_id, coalesce(brand, min(brand) OVER (PARTITION BY product_id)) AS brand FROM fx")
add("orphan_check", lambda s, d: quality.orphans(table(s, d, "customer").select("c_custkey", "c_name"), table(s, d, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey"), "SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
add("value_range", lambda s, d: quality.value_range(fx_events(s, d), ["event_time", "price"]), f"WITH {_FX} SELECT min(event_time) AS min_event_time, max(event_time) AS max_event_time, min(price) AS min_price, max(price) AS max_price FROM fx")

# Upserts --------------------------------------------------------------------------------


def _before(ev: DataFrame) -> DataFrame:
    return ev.filter(F.col("event_time") < F.lit(CUT).cast("timestamp_ntz"))


def _after(ev: DataFrame) -> DataFrame:
    return ev.filter(F.col("event_time") >= F.lit(CUT).cast("timestamp_ntz"))


def _dim(name: str, f: Callable[[DataFrame], DataFrame], frame: Query, keys: list[str], sql: str, drop: tuple[str, ...] = ()) -> None:
    """Dimension of the events before the cut, upserted with that of those after it."""
    add(f"merge_{name}", lambda s, d: upsert.insert_only(f(_before(frame(s, d))), f(_after(frame(s, d))), keys).drop(*drop), sql)


_dim("time_dim", star.time_dim, timed, ["time_id"], ORACLE["time_dim"], ("time_id",))
_dim("user_dim", star.user_dim, fx_events, ["user_id", "user_session"], ORACLE["user_dim"])
_OLD = f"e_old AS (SELECT * FROM clean WHERE event_time < TIMESTAMP '{CUT}'), e_new AS (SELECT * FROM clean WHERE event_time >= TIMESTAMP '{CUT}')"


def _dim_sql(block: str, key: str) -> str:
    return f"WITH {_CLEAN}, {_OLD}, o AS ({block.format('e_old')}), n AS ({block.format('e_new')}) SELECT * FROM o UNION ALL SELECT * FROM n WHERE {key} NOT IN (SELECT {key} FROM o)"


_CAT = """SELECT category_id, category_code, category_lv_1, category_lv_2, category_lv_3 FROM (SELECT category_id, category_code, category_lv_1, category_lv_2, category_lv_3,
 row_number() OVER (PARTITION BY category_id ORDER BY count(*) DESC, category_code) AS rn FROM {0} GROUP BY category_id, category_code, category_lv_1, category_lv_2, category_lv_3) WHERE rn = 1"""
_PRODUCT = "SELECT b.product_id, b.brand, p.price FROM " + _MODE.replace("{0}", "brand").replace("FROM clean", "FROM {0}") + " b JOIN " + _MODE.replace("{0}", "price").replace("FROM clean", "FROM {0}") + " p USING (product_id)"
_dim("category_dim", star.category_dim, cleaned, ["category_id"], _dim_sql(_CAT, "category_id"))
_dim("product_dim", star.product_dim, cleaned, ["product_id"], _dim_sql(_PRODUCT, "product_id"))
add(
    "merge_user_dim_by_user",
    lambda s, d: upsert.insert_only(star.user_dim(_before(fx_events(s, d))), star.user_dim(_after(fx_events(s, d))), ["user_id"]),
    f"WITH {_FX}, o AS (SELECT DISTINCT user_id, user_session FROM fx WHERE event_time < TIMESTAMP '{CUT}'), n AS (SELECT DISTINCT user_id, user_session FROM fx WHERE event_time >= TIMESTAMP '{CUT}') SELECT * FROM o UNION ALL SELECT * FROM n WHERE user_id NOT IN (SELECT user_id FROM o)",
)


def _merge_fact(s: SparkSession, d: str) -> DataFrame:
    """The last week loaded twice: the second load adds nothing."""
    ev = fx_events(s, d)
    old, new = star.fact_rows(_before(ev)), _after(ev)
    once = old.unionByName(star.new_facts(old, new))
    return once.unionByName(star.new_facts(once, new)).drop("time_id")


add("merge_fact", _merge_fact, ORACLE["fact"])


#: Windows of target (all before the first) and source (from the second to the third): they
#: overlap, so a MERGE keeps, updates and inserts rows.
DAYS, WEEKS, MONTHS = ("2024-01-05", "2024-01-04", "2024-01-07"), ("2024-01-16", "2024-01-10", "2024-02-01"), ("1998-07-01", "1998-05-10", "1999-03-01")
FIRST_MONTHS = ("1995-03-15", "1995-02-10", "1995-08-01")  # while users are still new
MERGES: dict[str, tuple[Query, Query, list[str]]] = {}


def _span(ev: DataFrame, start: str | None, end: str) -> DataFrame:
    t = F.col("event_time")
    late = t < F.lit(end).cast("timestamp_ntz")
    return ev.filter(late if start is None else late & (t >= F.lit(start).cast("timestamp_ntz")))


def _merge_staging(s: SparkSession, d: str) -> DataFrame:
    """Staging rows of the window are inserted by event_id; known ones stay, though the source's differ."""
    c = cleaned(s, d)
    f = star.fact(c)
    full = star.staging(f, star.category_dim(c), star.product_dim(c), star.time_dim(c))
    source = _span(full, DAYS[1], DAYS[2]).withColumn("brand", F.lit("changed"))
    return upsert.insert_only(_span(full, None, DAYS[0]), source, ["event_id"]).drop("event_id", "time_id")


add(
    "merge_staging_fact", _merge_staging,
    f"SELECT * REPLACE (CASE WHEN event_time >= TIMESTAMP '{DAYS[0]}' THEN 'changed' ELSE brand END AS brand) FROM ({ORACLE['fact_star_join']}) WHERE event_time < TIMESTAMP '{DAYS[2]}'",
)


def on_merge(like: str, f: Callable[[DataFrame], DataFrame], keys: list[str], frame: Query, window: tuple[str, str, str], name: str | None = None) -> None:
    """Metric of the events before window[0], upserted with that of those from window[1] to window[2]."""
    name = f"merge_{name or like}"
    target, source = (lambda s, d: f(_span(frame(s, d), None, window[0]))), (lambda s, d: f(_span(frame(s, d), window[1], window[2])))
    MERGES[name] = target, source, keys
    first = f", {_FIRST} "
    head, body = ORACLE[like].split(first, 1) if first in ORACLE[like] else ORACLE[like].split("SELECT * FROM st) ", 1)
    head = head if first in ORACLE[like] else head + "SELECT * FROM st)"
    part = lambda cond: f"(WITH ev AS (SELECT * FROM all_ev WHERE {cond}){first}{body})"
    same = " AND ".join(f"n.{k} = t.{k}" for k in keys)
    add(
        name, lambda s, d: (upsert.replace_groups if keys == ["month"] else upsert.update_insert)(target(s, d), source(s, d), keys),
        f"""{head}, all_ev AS (SELECT * FROM ev), t AS {part(f"event_time < TIMESTAMP '{window[0]}'")},
n AS {part(f"event_time >= TIMESTAMP '{window[1]}' AND event_time < TIMESTAMP '{window[2]}'")}
SELECT * FROM n UNION ALL SELECT * FROM t WHERE NOT EXISTS (SELECT 1 FROM n WHERE {same})""",
    )


for _name, _f, _keys, _window in (
    ("dau", M.dau, ["event_date"], DAYS),
    ("wau_iso", M.wau_iso, ["event_date"], WEEKS),
    ("active_users_full", M.active_users_full, ["event_date"], DAYS),
    ("event_type_time_distribution", M.event_type_time_distribution, ["event_time_month", "event_time_day_name", "event_time_hour", "event_type"], DAYS),
    ("conversion_rate", M.conversion_rate, ["event_time_ymd"], DAYS),
    ("count_visitors", M.count_visitors, ["event_time_ymd"], DAYS),
):
    on_merge(_name, _f, _keys, timed, _window)

on_merge("price_distribution", M.price_distribution, ["event_time_month", "event_time_day_name", "event_time_hour", "event_type"], staged, DAYS)

on_orders("orders_mau", M.mau, _MAU)
on_orders("orders_funnel", M.funnel, _FUNNEL)
for _name, _like, _f, _keys in (
    ("retention_daily", "orders_retention_daily", M.retention_daily, ["cohort_date", "day_diff"]),
    ("retention_weekly", "orders_retention_weekly", M.retention_weekly, ["cohort_month", "week_number"]),
    ("retention_monthly", "orders_retention_monthly", M.retention_monthly, ["cohort_date", "month_diff"]),
    ("retention_monthly_rate", "orders_retention_monthly_rate", M.retention_monthly_rate, ["cohort_month", "month_label"]),
    ("mau", "orders_mau", M.mau, ["event_date"]),
    ("stickiness", "orders_stickiness", M.stickiness, ["event_date"]),
    ("funnel", "orders_funnel", M.funnel, ["month", "event_type"]),
    ("monthly_price_event_type", "orders_monthly_price", M.monthly_price_event_type, ["month", "event_type"]),
    ("purchased_order", "orders_purchased", M.purchased_order, ["event_time_ymd"]),
    ("category_lv2_top10", "orders_category_top10", M.category_lv2_top, ["month"]),  # a month's ranking is replaced as a whole
):
    on_merge(_like, _f, _keys, fx_orders, FIRST_MONTHS if "retention" in _name else MONTHS, _name)

add("merge_latest_date", lambda s, d: M.latest_date(_before(timed(s, d))).unionByName(M.latest_date(_after(timed(s, d)))).agg(F.max("latest_event_time").alias("latest_event_time")), ORACLE["latest_date"])

# Tables -----------------------------------------------------------------------------------


def _rewritten_weeks(s: SparkSession, d: str) -> DataFrame:
    """Cleaned events by weeks; the week of the cut is written again, as after a retry."""
    path, c = shared_path(s, "weeks"), cleaned(s, d)
    E.write_weeks(c, path, ANCHOR)
    E.write_weeks(_span(c, CUT, "2024-01-29"), path, ANCHOR)
    return E.read_weeks(s, path).select(*RAW_COLUMNS, F.col("week_start").cast("date").alias("week_start"))


def _missing_weeks_written(s: SparkSession, d: str) -> DataFrame:
    """Weeks that are there stay as they are, though the second write has other rows for them."""
    path, c = shared_path(s, "weeks"), cleaned(s, d)
    E.write_weeks(_before(c), path, ANCHOR)
    E.write_missing_weeks(c.withColumn("brand", F.lit("changed")), path, ANCHOR)
    return E.read_weeks(s, path).select(*RAW_COLUMNS)


def _copied(s: SparkSession, d: str, weeks: list[str]) -> DataFrame:
    """The raw table: a full copy, then the copy of each of the weeks again."""
    source, target = shared_path(s, "source"), shared_path(s, "raw")
    cleaned(s, d).write.parquet(source)
    E.copy_into(s, source, target)
    for week in weeks:
        E.copy_into(s, source, target, week)
    return E.read_weeks(s, target).select(*RAW_COLUMNS)


def _reset(s: SparkSession, d: str) -> DataFrame:
    """Rows of each table after a reset of tables that held some."""
    root = shared_path(s, "tables")
    star.user_dim(fx_events(s, d)).write.parquet(f"{root}/user_dim")
    reset_tables(s, root)
    counts = [s.read.parquet(f"{root}/{n}").agg(F.count("*").alias("n_rows")).select(F.lit(n).alias("table_name"), F.lit(len(k.fields)).cast("long").alias("n_columns"), "n_rows") for n, k in {"raw_data": RAW, **STAR}.items()]
    return reduce(DataFrame.unionByName, counts)


_roots: dict[tuple[str, str, str], str] = {}


def _root(s: SparkSession, d: str, kind: str, make: Callable[[str], None]) -> str:
    """The root of tables that several queries read, made once in an application."""
    key = (s.sparkContext.applicationId, d, kind)
    if key not in _roots:
        root = shared_path(s, kind)
        make(root)
        _roots[key] = root
    return _roots[key]


def _loaded(name: str) -> Query:
    def run(s: SparkSession, d: str) -> DataFrame:
        """Loaded up to the cut, then the rest, then the rest again: appended once."""

        def make(root: str) -> None:
            ev = fx_events(s, d)
            for part in (_before(ev), _after(ev), _after(ev)):
                pipeline.load(s, root, C.clean_events(part, ANCHOR))

        return upsert.current(s, _root(s, d, "star", make), name)

    return run


_RAW_SQL = f"WITH {_CLEAN} SELECT {', '.join(RAW_COLUMNS)} FROM clean"
add("weeks_rewritten", _rewritten_weeks, f"SELECT *, CAST(date_trunc('week', event_time) AS DATE) AS week_start FROM ({_RAW_SQL})")
add("weeks_missing_written", _missing_weeks_written, f"SELECT * REPLACE (CASE WHEN event_time >= TIMESTAMP '{CUT}' THEN 'changed' ELSE brand END AS brand) FROM ({_RAW_SQL})")
add("copy_into_full", lambda s, d: _copied(s, d, []), _RAW_SQL)
add("copy_into_week", lambda s, d: _copied(s, d, ["2024-01-08", "2024-01-15"]), _RAW_SQL)
add("reset_tables", _reset, "SELECT * FROM (VALUES ('raw_data', 18, 0), ('time_dim', 8, 0), ('category_dim', 5, 0), ('product_dim', 3, 0), ('user_dim', 2, 0), ('fact', 7, 0)) AS v(table_name, n_columns, n_rows)")
add("incremental_fact", lambda s, d: _loaded("fact")(s, d).drop("event_id"), f"WITH {_EV} SELECT CAST(epoch_us(event_time) AS BIGINT) AS time_id, category_id, product_id, user_id, user_session, event_type FROM ev")
add("incremental_user_dim", _loaded("user_dim"), ORACLE["user_dim"])
add("impute_counting_nulls", lambda s, d: C.impute_counting_nulls(_weekly(s, d), "product_id", "brand").select("product_id", "event_time", "user_id", "brand"), f"""WITH {_EV},
 c AS (SELECT week_start, product_id, brand, count(*) AS n FROM ev GROUP BY ALL),
 m AS (SELECT week_start, product_id, brand AS mode FROM (SELECT *, row_number() OVER (PARTITION BY week_start, product_id ORDER BY n DESC, brand IS NULL, brand) AS rn FROM c) WHERE rn = 1)
 SELECT product_id, event_time, user_id, coalesce(brand, mode) AS brand FROM ev LEFT JOIN m USING (week_start, product_id)""")
add("windowed_star_join", lambda s, d: _span(staged(s, d), "2024-01-08", "2024-01-15"), f"SELECT * FROM ({ORACLE['fact_star_join']}) WHERE event_time >= TIMESTAMP '2024-01-08' AND event_time < TIMESTAMP '2024-01-15'")

# Loads, step by step ------------------------------------------------------------------------

#: The middle weeks first, then the last, then the first, so that cohorts move.
LOADS = ("event_time >= '2024-01-08' AND event_time < '2024-01-22'", "event_time >= '2024-01-22'", "event_time < '2024-01-08'")


def loaded_root(s: SparkSession, d: str) -> str:
    """The tables after three loads."""

    def make(root: str) -> None:
        clean = written(cleaned(s, d), "cleaned")
        for part in LOADS:
            pipeline.run_load(s, root, clean.filter(part), ANCHOR)

    return _root(s, d, "loads", make)


_NTH = " ".join(f"WHEN {p.replace(chr(39) + '2024', 'TIMESTAMP ' + chr(39) + '2024')} THEN {n}" for n, p in enumerate(LOADS))
_MODES = """{0}_of AS (SELECT product_id, {0} FROM (SELECT product_id, {0}, row_number() OVER (PARTITION BY product_id
 ORDER BY nth, count(*) DESC, max(event_time) DESC, {0} NULLS FIRST) AS rn FROM cl GROUP BY nth, product_id, {0}) WHERE rn = 1)"""
_LEVELS = "category_code, category_lv_1, category_lv_2, category_lv_3"
#: A key's dimension row is that of the first load that has it.
_INC = f"""{_CLEAN.replace('ev AS', 'e0 AS', 1).replace('FROM ev)', 'FROM e0)', 1)}, cl AS (SELECT *, CASE {_NTH} END AS nth FROM clean), {_MODES.format('brand')}, {_MODES.format('price')},
cats AS (SELECT category_id, {_LEVELS} FROM (SELECT category_id, {_LEVELS}, row_number() OVER (PARTITION BY category_id ORDER BY nth, count(*) DESC, category_code) AS rn
 FROM cl GROUP BY nth, category_id, {_LEVELS}) WHERE rn = 1),
ev AS (SELECT c.user_id, c.user_session, c.category_id, c.product_id, c.event_type, c.event_time, c.event_time_ymd, c.event_time_hms, c.event_time_month, c.event_time_day,
 c.event_time_hour, c.event_time_day_name, d.category_code, d.category_lv_1, d.category_lv_2, d.category_lv_3, b.brand, p.price
 FROM clean c LEFT JOIN cats d USING (category_id) LEFT JOIN brand_of b USING (product_id) LEFT JOIN price_of p USING (product_id))"""
_ACTIVE = f"SELECT event_date, dau, wau, mau FROM ({_DAU}) LEFT JOIN ({_WAU}) USING (event_date) LEFT JOIN ({_MAU}) USING (event_date)"

for _name, _sql in (
    ("event_type_time_distribution", _ETTD), ("conversion_rate", _CONV), ("funnel", _FUNNEL), ("price_distribution", _PRICE),
    ("monthly_price_event_type", _MPE), ("purchased_order", _ORDERED), ("count_visitors", _VISIT), ("dau", _DAU), ("wau", _WAU), ("mau", _MAU),
    ("stickiness", _STICK), ("active_users", _ACTIVE), ("stickiness_mau", f"SELECT event_date, mau, stickiness FROM ({_MAU}) JOIN ({_STICK}) USING (event_date)"),
    ("retention_daily", _RET_D), ("retention_monthly", _RET_M), ("retention_monthly_rate", _RET_R),
    ("retention_weekly", f"SELECT * FROM ({_RET_W}) WHERE week_number BETWEEN 0 AND 4"), ("category_lv2_top", _LV2),
    ("rfm_combined", f"SELECT *, rfm_value_segment || ' - ' || customer_segment AS combined_segment FROM ({_RFM})"),
    ("latest_date", "SELECT max(event_time) AS latest_event_time FROM ev"),
):
    add(f"load_{_name}", lambda s, d, n=_name: pipeline.table(s, loaded_root(s, d), n), f"WITH {_INC}, {_FIRST} {_sql}")
add("load_staging", lambda s, d: pipeline.staging(s, loaded_root(s, d)).drop("event_id", "time_id"), f"WITH {_INC} SELECT * FROM ev")
add(
    "load_staging_window", lambda s, d: pipeline.staging(s, loaded_root(s, d), "2024-01-10", "2024-01-17").drop("event_id", "time_id"),
    f"WITH {_INC} SELECT * FROM ev WHERE event_time >= TIMESTAMP '2024-01-10' AND event_time < TIMESTAMP '2024-01-18'",
)


def holed(ev: DataFrame) -> DataFrame:
    """Events of some types lose their session, user or product: keys with nulls."""
    hole = lambda c, kind: F.when(F.col("event_type") != kind, F.col(c)).alias(c)
    return ev.withColumns({"user_session": hole("user_session", "error"), "product_id": hole("product_id", "signup"), "user_id": hole("user_id", "error")})


def _reloaded(name: str) -> Query:
    def run(s: SparkSession, d: str) -> DataFrame:
        """Events with nulls in their keys: up to the cut, then the rest, then the rest again."""

        def make(root: str) -> None:
            clean = written(C.clean_events(holed(fx_events(s, d)), ANCHOR), "cleaned")
            for part in (_before(clean), _after(clean), _after(clean)):
                pipeline.load(s, root, part)

        return upsert.current(s, _root(s, d, "reloads", make), name)

    return run


_HOLED = f"""{_FX}, h AS (SELECT * REPLACE (CASE WHEN event_type <> 'error' THEN user_session END AS user_session, CASE WHEN event_type <> 'signup' THEN product_id END AS product_id,
 CASE WHEN event_type <> 'error' THEN user_id END AS user_id), event_time >= TIMESTAMP '{CUT}' AS late, CAST(epoch_us(event_time) AS BIGINT) AS time_id FROM fx)"""
_KEYS = ("time_id", "category_id", "product_id", "user_id", "user_session", "event_type")
add(
    "reload_fact_ids", _reloaded("fact"),
    f"WITH {_HOLED} SELECT row_number() OVER (ORDER BY late, {', '.join(f'{k} NULLS FIRST' for k in _KEYS)}) AS event_id, {', '.join(_KEYS)} FROM h",
)
add("reload_user_dim", _reloaded("user_dim"), f"WITH {_HOLED} SELECT DISTINCT user_id, user_session FROM h")
add("reload_time_dim", lambda s, d: _reloaded("time_dim")(s, d).select("time_id", "event_time"), f"WITH {_HOLED} SELECT DISTINCT time_id, event_time FROM h")

# MERGE with actions: target and source are feeds of overlapping windows or key ranges --------


def on_feeds(name: str, f: Callable[[DataFrame], DataFrame], keys: list[str], frame: Query, old: str, new: str, body: str, head: str) -> None:
    """Dimension of the feed ``old`` merged with that of the feed ``new``; every action that applies occurs."""
    add(
        f"merge_actions_{name}",
        lambda s, d: upsert.merge(f(frame(s, d).filter(old)), f(frame(s, d).filter(new)), keys, update=False, several=name == "user_dim_by_user"),
        f"""WITH {head}, o AS ({body.format(old)}), n AS ({body.format(new)})
SELECT *, 'kept' AS action FROM o UNION ALL SELECT *, 'inserted' AS action FROM n WHERE NOT EXISTS (SELECT 1 FROM o WHERE {' AND '.join(f'o.{k} = n.{k}' for k in keys)})""",
    )


_EARLY, _LATE = f"event_time < TIMESTAMP '{DAYS[0]}'", f"event_time >= TIMESTAMP '{DAYS[1]}' AND event_time < TIMESTAMP '{DAYS[2]}'"
FEEDS = {
    "time_dim": (star.time_dim, ["time_id"], timed, _EARLY, _LATE),
    "user_dim": (star.user_dim, ["user_id", "user_session"], timed, _EARLY, _LATE),
    "user_dim_by_user": (star.user_dim, ["user_id"], timed, f"user_id < '6' AND {_EARLY}", "user_id > '3'"),
    "category_dim": (star.category_dim, ["category_id"], cleaned, f"category_id < 'N' AND {_EARLY}", "category_id > 'F'"),
    "product_dim": (star.product_dim, ["product_id"], cleaned, f"product_id < '7' AND {_EARLY}", "product_id > '3'"),
}
_TIMES = "SELECT DISTINCT CAST(epoch_us(event_time) AS BIGINT) AS time_id, event_time, event_time_ymd, event_time_hms, event_time_month, event_time_day, event_time_hour, event_time_day_name FROM ev WHERE {}"
_BODY = {
    "time_dim": (_TIMES, _EV), "user_dim": ("SELECT DISTINCT user_id, user_session FROM ev WHERE {}", _EV),
    "user_dim_by_user": ("SELECT DISTINCT user_id, user_session FROM ev WHERE {}", _EV),
    "category_dim": (_CAT.replace("{0}", "(SELECT * FROM clean WHERE {0})"), _CLEAN), "product_dim": (_PRODUCT.replace("{0}", "(SELECT * FROM clean WHERE {0})"), _CLEAN),
}
for _name, (_f, _keys, _frame, _old, _new) in FEEDS.items():
    on_feeds(_name, _f, _keys, _frame, _old, _new, *_BODY[_name])

add(
    "merge_actions_dau", lambda s, d: upsert.merge(M.dau(timed(s, d).filter(_EARLY)), M.dau(timed(s, d).filter(_LATE)), ["event_date"], update=True),
    f"""WITH {_EV}, o AS ({_DAU.replace('FROM ev', f'FROM ev WHERE {_EARLY}')}), n AS ({_DAU.replace('FROM ev', f'FROM ev WHERE {_LATE}')})
SELECT n.*, CASE WHEN event_date IN (SELECT event_date FROM o) THEN 'updated' ELSE 'inserted' END AS action FROM n UNION ALL SELECT *, 'kept' FROM o WHERE event_date NOT IN (SELECT event_date FROM n)""",
)
add(
    "merge_latest_on_true", lambda s, d: upsert.replace_row(M.latest_date(_before(timed(s, d))), M.latest_date(_span(timed(s, d), *DAYS[1:]))),
    f"WITH {_EV} SELECT max(event_time) AS latest_event_time FROM ev WHERE {_LATE}",
)

# Distinct counts from daily bitmaps ----------------------------------------------------------


def _daily_bits(s: SparkSession, d: str) -> DataFrame:
    """Bitmaps by day over a map of users that grew in two steps."""
    ev = written(timed(s, d).select("user_id", D.day("event_time").alias("day")).distinct(), "user-days")
    first = written(bitmaps.id_map(ev.filter(f"day < '{CUT}'"), "user_id"), "ids")
    return bitmaps.daily(ev, bitmaps.id_map(ev, "user_id", first), "user_id", "day")


for _name, _by, _value, _sql in (
    ("dau", F.to_date, "dau", _DAU), ("wau", D.bin_start, "wau", _WAU), ("wau_iso", D.week, "wau", _WAU_ISO), ("mau", D.month, "mau", _MAU),
):
    add(
        f"bitmap_{_name}", lambda s, d, by=_by, v=_value: bitmaps.counts(bitmaps.rolled(_daily_bits(s, d), by("day"), "event_date"), "event_date", v),
        f"WITH {_EV} {_sql}",
    )

# Copies and checks that can fail ---------------------------------------------------------------


def _new_weeks(s: SparkSession, d: str) -> DataFrame:
    """A raw table with one week; two more are copied in, one of them twice."""
    source, target = shared_path(s, "source"), shared_path(s, "raw")
    cleaned(s, d).write.parquet(source)
    for week in ("2024-01-01", "2024-01-08", "2024-01-15", "2024-01-08"):
        E.copy_into(s, source, target, week)
    return E.read_weeks(s, target).select(*RAW_COLUMNS)


add("copy_into_new_weeks", _new_weeks, f"SELECT * FROM ({_RAW_SQL}) WHERE event_time < TIMESTAMP '2024-01-22'")
add(
    "orphan_documents", lambda s, d: quality.orphans(table(s, d, "documents").select("doc_id", "source"), table(s, d, "labels"), "doc_id"),
    "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
)

# Loading past bad rows and files --------------------------------------------------------------

_CSV = ("event_time", "event_type", "product_id", "category_id", "category_code", "brand", "price", "user_id", "user_session")
BAD_ROW = f"event_type = 'error' AND event_time >= TIMESTAMP '{CUT}'"


def _csv_folder(s: SparkSession, d: str) -> str:
    """Folders early and late of CSV files; rows of BAD_ROW have no number for a price."""
    path = shared_path(s, "csv")
    price = F.when(F.expr(BAD_ROW), "n/a").otherwise(F.col("price").cast("string"))
    ev = fx_events(s, d)
    for name, part in (("early", _before(ev)), ("late", _after(ev))):
        said = part.withColumn("price", price).withColumn("event_time", F.date_format("event_time", "yyyy-MM-dd HH:mm:ss"))
        said.select(*_CSV).write.option("header", True).csv(f"{path}/{name}")
    return path


def _rejected(s: SparkSession, d: str) -> DataFrame:
    rows, bad = rejects.read_csv(s, _csv_folder(s, d))
    return bad.select("record")


def _folder(c: str):
    return F.element_at(F.split(c, "/"), -2).alias("folder")


def _by_folder(report: DataFrame) -> DataFrame:
    return report.groupBy(_folder("file"), "status").agg(F.sum("rows_loaded").alias("rows_loaded"), F.sum("rows_rejected").alias("rows_rejected"))


def _csv_report(s: SparkSession, d: str) -> DataFrame:
    path = _csv_folder(s, d)
    return _by_folder(rejects.csv_report(s, path, *rejects.read_csv(s, path))).groupBy("folder").agg(
        F.sum("rows_loaded").alias("rows_loaded"), F.sum("rows_rejected").alias("rows_rejected")
    )  # which of a folder's files hold bad rows is the writer's choice


def _parquet_report(s: SparkSession, d: str) -> DataFrame:
    """Raw data beside a file that isn't Parquet."""
    path = shared_path(s, "parquet")
    cleaned(s, d).write.parquet(f"{path}/good")
    fs, p = E.hadoop_fs(s, f"{path}/bad/broken.parquet")
    out = fs.create(p)
    out.write(bytearray(b"not a table" * 100))
    out.close()
    return _by_folder(rejects.parquet_report(s, path, written(rejects.read_parquet(s, path), "loaded")))


_LINES = f"""SELECT strftime(event_time, '%Y-%m-%d %H:%M:%S') || ',' || event_type || ',' || product_id || ',' || category_id || ',' || coalesce(category_code, '') || ',' ||
 coalesce(brand, '') || ',n/a,' || user_id || ',' || user_session AS record FROM fx WHERE {BAD_ROW}"""
add("copy_rejected_rows", _rejected, f"WITH {_FX} {_LINES}")
add("copy_csv_report", _csv_report, f"""WITH {_FX} SELECT CASE WHEN event_time >= TIMESTAMP '{CUT}' THEN 'late' ELSE 'early' END AS folder,
 count(*) FILTER (WHERE NOT ({BAD_ROW})) AS rows_loaded, count(*) FILTER (WHERE {BAD_ROW}) AS rows_rejected FROM fx GROUP BY 1""")
add("copy_parquet_report", _parquet_report, f"WITH {_FX} SELECT 'good' AS folder, 'LOADED' AS status, count(*) AS rows_loaded, 0::BIGINT AS rows_rejected FROM fx UNION ALL SELECT 'bad', 'LOAD_FAILED', 0, NULL")

# A script of several statements over a given table --------------------------------------------

#: Parameters: first_day, last_day, target. Loads week by week; a failure leaves no half-filled table.
WEEKS_SCRIPT = """
BEGIN
  DECLARE monday DATE DEFAULT date_trunc('week', session.first_day);
  DECLARE EXIT HANDLER FOR SQLEXCEPTION
  BEGIN
    DROP TABLE IF EXISTS IDENTIFIER(session.target);
    SELECT CAST(NULL AS DATE) AS event_date, CAST(NULL AS STRING) AS event_type, CAST(NULL AS BIGINT) AS cnt WHERE false;
  END;
  CREATE TABLE IDENTIFIER(session.target) (event_date DATE, event_type STRING, cnt BIGINT) USING parquet;
  WHILE monday <= session.last_day DO
    INSERT INTO IDENTIFIER(session.target)
      SELECT CAST(event_time AS DATE), event_type, count(*) FROM script_events
      WHERE event_time >= monday AND event_time < date_add(monday, 7)
        AND CAST(event_time AS DATE) BETWEEN session.first_day AND session.last_day GROUP BY ALL;
    SET monday = date_add(monday, 7);
  END WHILE;
  SELECT * FROM IDENTIFIER(session.target);
END
"""


def _script(s: SparkSession, d: str) -> DataFrame:
    fx_events(s, d).createOrReplaceTempView("script_events")
    target = "weeks_" + shared_path(s, "x").rsplit("-", 1)[-1]
    return run_block(s, WEEKS_SCRIPT, {"first_day": dt.date(2024, 1, 3), "last_day": dt.date(2024, 1, 25), "target": target})


add("script_weeks", _script, f"WITH {_FX} SELECT CAST(event_time AS DATE) AS event_date, event_type, count(*) AS cnt FROM fx WHERE CAST(event_time AS DATE) BETWEEN DATE '2024-01-03' AND DATE '2024-01-25' GROUP BY ALL")

# The staging join of bucketed tables ------------------------------------------------------------


def bucketed(s: SparkSession, d: str, n: int = 8) -> DataFrame:
    """Staging from a fact and a product table in buckets of product_id."""
    clean, tag = written(cleaned(s, d), "cleaned"), shared_path(s, "x").rsplit("-", 1)[-1]
    buckets.save(star.fact_rows(clean), f"fact_{tag}", "product_id", n)
    buckets.save(star.product_dim(clean), f"product_{tag}", "product_id", n)
    return buckets.staging(s, f"fact_{tag}", f"product_{tag}", written(star.category_dim(clean), "categories"))


add("staging_bucketed", lambda s, d: bucketed(s, d).drop("time_id"), ORACLE["fact_star_join"])
