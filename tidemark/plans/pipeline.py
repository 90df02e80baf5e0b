"""The initial and the weekly load over Parquet tables under one root.

A load writes the star schema's new rows, their staging rows, and the analysis rows that they touch
(see ``refresh``), all under one mark: until it is set, readers see the tables of the load before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.clean import clean_events
from tidemark.functions.dates import bin_start, in_window
from tidemark.operators import star
from tidemark.operators.upsert import Load, current, new_rows, paths, spread_table
from tidemark.plans import metrics, refresh
from tidemark.plans.state import State
from tidemark.session import scratch, written

MAX_PARTS = 60
ANCHOR = "2024-01-01"
DIM_KEYS = {"time_dim": ["time_id"], "category_dim": ["category_id"], "product_dim": ["product_id"], "user_dim": ["user_id", "user_session"]}

ANALYSIS = {
    f.__name__: f
    for f in (
        metrics.event_type_time_distribution, metrics.conversion_rate, metrics.retention_daily, metrics.retention_weekly,
        metrics.retention_monthly, metrics.retention_monthly_rate, metrics.dau, metrics.wau, metrics.mau, metrics.stickiness,
        metrics.active_users, metrics.stickiness_mau, metrics.funnel, metrics.count_visitors, metrics.rfm_combined,
        metrics.purchased_order, metrics.price_distribution, metrics.monthly_price_event_type, metrics.latest_date, metrics.category_lv2_top,
    )
}


def build_star(clean: DataFrame) -> dict[str, DataFrame]:
    return {
        "time_dim": star.time_dim(clean), "category_dim": star.category_dim(clean), "product_dim": star.product_dim(clean),
        "user_dim": star.user_dim(clean), "fact": star.fact(clean),
    }


def write_star(run: Load, clean: DataFrame, anchor: str = ANCHOR) -> DataFrame:
    """Upsert clean events into the star schema within a load: new keys are added, known ones stay.

    clean is written once and read by all tables. Only new rows are written, as additions to a table's
    files; after MAX_PARTS additions a dimension is written anew as one. Dimension keys are compared null
    to null, facts by all their columns, so loading a week twice changes nothing. Known facts are looked
    for in the load's range of times only: FACT's files are sorted by time_id. Returns the new rows of
    FACT as a written table.
    """
    spark, root = run.spark, run.root
    clean = written(clean, "clean")
    combos = written(star.combinations(clean), "combinations")  # both keyed dimensions come from these few rows
    dims = {"time_dim": star.time_dim(clean), "category_dim": star.category_of(combos), "product_dim": star.product_of(combos), "user_dim": star.user_dim(clean)}
    low, high = clean.agg(F.min(star.time_id()), F.max(star.time_id())).first()
    for name, df in dims.items():
        old = current(spark, root, name, run)
        if old is None:
            run.publish(df, name)
            continue
        known = old.filter(F.col("time_id").between(low, high)) if name == "time_dim" else old
        run.append(new_rows(known, df, DIM_KEYS[name], null_safe=True), name)
        if len(paths(spark, root, name, run)) > MAX_PARTS:
            run.publish(current(spark, root, name, run), name)
    old, ids = current(spark, root, "fact", run), current(spark, root, "fact_ids", run)
    last = ids.agg(F.max("last_id")).first()[0] if ids is not None else 0
    more = star.fact_rows(clean) if old is None else star.new_facts(old.filter(F.col("time_id").between(low, high)), clean)
    path = (run.publish if old is None else run.append)(star.with_event_ids(more, last), "fact")
    added = spark.read.parquet(path)
    run.append(added.agg(F.coalesce(F.max("event_id"), F.lit(last)).alias("last_id")), "fact_ids")
    return added


def load(spark: SparkSession, root: str, clean: DataFrame, anchor: str = ANCHOR) -> None:
    """One load of the star schema: readers see all its tables' new rows, or none."""
    with scratch(spark):
        run = Load(spark, root)
        write_star(run, clean, anchor)
        run.commit()


STAGING = (
    "event_id bigint, time_id bigint, category_id string, product_id string, user_id string, user_session string, event_type string, "
    "category_code string, category_lv_1 string, category_lv_2 string, category_lv_3 string, brand string, price double, event_time timestamp_ntz, "
    "event_time_ymd date, event_time_hms string, event_time_month string, event_time_day string, event_time_hour string, event_time_day_name string"
)


def write_staging(run: Load, added: DataFrame, anchor: str = ANCHOR) -> DataFrame:
    """Join a load's new facts to the dimensions and add them to staging, in folders by week; a
    dimension row never changes once it is there, so older staging rows stay right."""
    dims = [current(run.spark, run.root, n, run) for n in ("category_dim", "product_dim", "time_dim")]
    rows = star.staging(added, *dims).withColumn("week_start", bin_start("event_time", anchor))
    rows = written(rows, "staging")
    run.spread(rows, "staging", "week_start")
    return rows.drop("week_start")


def staging(spark: SparkSession, root: str, start: str | None = None, end: str | None = None, anchor: str = ANCHOR) -> DataFrame | None:
    """The staging table, or its days start to end (both included): other weeks' files aren't read."""
    df = spread_table(spark, root, "staging", f"{STAGING}, week_start date")
    if df is not None and start is not None:
        weeks = F.col("week_start").between(bin_start(F.lit(start), anchor), bin_start(F.lit(end), anchor))
        df = df.filter(weeks & in_window(F.col("event_time"), start, end))
    return None if df is None else df.drop("week_start")


def full_refresh(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """Every analysis table computed from all of staging: what a load's refresh must be equal to."""
    ev = staging(spark, root)
    return {name: f(ev) for name, f in ANALYSIS.items()}


def table(spark: SparkSession, root: str, name: str) -> DataFrame | None:
    """An analysis table as it stands."""
    return refresh.read(refresh.Store(spark, root), name)


def run_load(spark: SparkSession, root: str, clean: DataFrame, anchor: str = ANCHOR, state: tuple[str, str] | None = None) -> dict[str, int]:
    """Star, staging, state and analysis tables in one load under one mark; rows written to the analysis tables."""
    with scratch(spark):
        run = Load(spark, root)
        added = write_staging(run, write_star(run, clean, anchor), anchor)
        wrote = refresh.refresh(refresh.Store(spark, root, run), added)
        if state:
            run.publish(State.frame(spark, *state), "state")
        run.commit()
    return wrote


def initial(spark: SparkSession, root: str, events: DataFrame, start: str, end: str, anchor: str) -> None:
    run_load(spark, root, clean_events(events.filter(in_window(events["event_time"], start, end)), anchor), anchor)


def weekly(spark: SparkSession, root: str, events: DataFrame, anchor: str) -> dict[str, str]:
    """Load the week the state points to and move the clock, in one load."""
    state = State(spark, root)
    state.reset()
    w = state.window()
    clean = clean_events(events.filter(in_window(events["event_time"], w["start_date"], w["end_date"])), anchor)
    run_load(spark, root, clean, anchor, state=("done", w["next_date"]))
    return w
