"""Star schema: unique dimension keys, deterministic surrogate ids, the staging join.

A dimension has one row for each key, so the staging join never multiplies events. time_id is
the event time in unix microseconds. event_id is dense: a load numbers the rows that FACT doesn't hold
yet from the highest id on, so ids are unique whatever the keys are, and stay when a week is loaded
again. FACT itself is the map from keys to ids.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.rank import dense_ids
from tidemark.schema import TIME_COLUMNS

FACT_KEY = ["time_id", "category_id", "product_id", "user_id", "user_session", "event_type"]


def time_id(c: Column | str = "event_time") -> Column:
    return F.unix_micros(F.col(c).cast("timestamp") if isinstance(c, str) else c.cast("timestamp"))


def time_dim(clean: DataFrame) -> DataFrame:
    return clean.select(time_id().alias("time_id"), *TIME_COLUMNS).distinct()


def user_dim(clean: DataFrame) -> DataFrame:
    return clean.select("user_id", "user_session").distinct()


CODES = ["category_code", "category_lv_1", "category_lv_2", "category_lv_3"]


def combinations(clean: DataFrame) -> DataFrame:
    """Distinct combinations of dimension values with their count and latest time: both dimensions
    come from this frame, so one shuffle of partial counts serves all."""
    return clean.groupBy("category_id", *CODES, "product_id", "brand", "price").agg(F.count("*").alias("rows"), F.max(time_id()).alias("newest"))


def category_dim(clean: DataFrame) -> DataFrame:
    """One row for each category_id: its most frequent code, on a tie the smallest."""
    return category_of(clean.groupBy("category_id", *CODES).agg(F.count("*").alias("rows")))


def category_of(combos: DataFrame) -> DataFrame:
    cols = CODES
    counts = combos.groupBy("category_id", *cols).agg(F.sum("rows").alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("rank"), *cols))
    return counts.groupBy("category_id").agg(best.alias("b")).select("category_id", *[F.col(f"b.{c}").alias(c) for c in cols])


def product_dim(clean: DataFrame) -> DataFrame:
    """product_id with its mode brand and mode price, picked independently: the most frequent,
    then latest, then smallest (null first)."""
    return product_of(clean.groupBy("product_id", "brand", "price").agg(F.count("*").alias("rows"), F.max(time_id()).alias("newest")))


def product_of(combos: DataFrame) -> DataFrame:
    """From counts by brand and price: windows over these few rows, one aggregate for both values."""

    def mode(value: str) -> Column:
        own = Window.partitionBy("product_id", value)
        return F.struct((-F.sum("rows").over(own)).alias("a"), (-F.max("newest").over(own)).alias("b"), F.col(value).alias("v"))

    picks = combos.select("product_id", mode("brand").alias("brand"), mode("price").alias("price"))
    best = picks.groupBy("product_id").agg(F.min("brand").alias("brand"), F.min("price").alias("price"))
    return best.select("product_id", F.col("brand.v").alias("brand"), F.col("price.v").alias("price"))


def fact_rows(clean: DataFrame) -> DataFrame:
    """The fact's columns but its id."""
    return clean.select(time_id().alias("time_id"), *FACT_KEY[1:])


def with_event_ids(rows: DataFrame, after: int = 0) -> DataFrame:
    """FACT rows with ids after+1, after+2, ... in the order of their columns (nulls first)."""
    return dense_ids(rows.select(*FACT_KEY), FACT_KEY, "event_id", after).select("event_id", *FACT_KEY)


def fact(clean: DataFrame) -> DataFrame:
    return with_event_ids(fact_rows(clean))


def new_facts(old: DataFrame, clean: DataFrame) -> DataFrame:
    """The rows that clean has more often than FACT, as often as it has them more.

    Rows are compared by all their columns, null equal to null, so no event is taken for another. Both
    sides are counted in one aggregation, whose partial sums bring rows that recur by the million to a
    row for each task.
    """
    each = lambda df, sign: df.select(*FACT_KEY, F.lit(sign).alias("n"))
    more = each(fact_rows(clean), 1).unionAll(each(old, -1)).groupBy(*FACT_KEY).agg(F.sum("n").alias("n")).filter("n > 0")
    return more.select(*FACT_KEY, F.explode(F.sequence(F.lit(1), F.col("n")))).select(*FACT_KEY)


def staging(fact_: DataFrame, category: DataFrame, product: DataFrame, time: DataFrame) -> DataFrame:
    """FACT left-joined to its dimensions, all by unique keys."""
    return fact_.join(category, "category_id", "left").join(product, "product_id", "left").join(time, "time_id", "left")


def staged(clean: DataFrame) -> DataFrame:
    """Staging in one step from clean events: the time columns are functions of event_time,
    so only the category and product lookups remain as joins."""
    base = clean.select("user_id", "user_session", "category_id", "product_id", "event_type", *TIME_COLUMNS)
    combos = combinations(clean)
    return base.join(category_of(combos), "category_id", "left").join(product_of(combos), "product_id", "left")


def mode_price(events: DataFrame) -> DataFrame:
    """product_id and its price as in ``product_dim``. Prices are never imputed, so raw events will do."""
    counts = events.groupBy("product_id", "price").agg(F.count("*").alias("rows"), F.max(time_id()).alias("newest"))
    best = F.min(F.struct((-F.col("rows")).alias("a"), (-F.col("newest")).alias("b"), F.col("price").alias("v")))
    return counts.groupBy("product_id").agg(best.alias("p")).select("product_id", F.col("p.v").alias("price"))


def priced(events: DataFrame) -> DataFrame:
    """Events at their product's mode price: staging for what needs no brand and no category, with one lookup and without imputation."""
    timed = events.filter("event_time is not null")
    return timed.drop("price").join(mode_price(timed), "product_id", "left")
