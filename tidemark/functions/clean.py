"""Cleaning: mode imputation, unknown fill, category levels, time parts."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.dates import bin_start
from tidemark.schema import RAW_COLUMNS

#: Imputation steps. The order matters: a later step sees what earlier ones filled.
IMPUTE_STEPS = (
    ("product_id", "category_code"),
    ("category_id", "category_code"),
    ("product_id", "brand"),
    ("category_id", "brand"),
)


def group_mode(df: DataFrame, keys: Sequence[str], target: str) -> DataFrame:
    """keys and the most frequent non-null target of each group; on a tie the smallest.

    Counts are partial sums before the shuffle; the pick is an aggregate too, so no window
    sorts a group.
    """
    counts = df.filter(F.col(target).isNotNull()).groupBy(*keys, target).agg(F.count("*").alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("rank"), F.col(target).alias("value")))
    return counts.groupBy(*keys).agg(best.alias("best")).select(*keys, F.col("best.value").alias("__mode"))


def impute_by_mode(df: DataFrame, group_col: str, target: str, scope: Sequence[str] = ("week_start",)) -> DataFrame:
    """Fill nulls of target with the mode of its group within the scope.

    The map has a row per group: AQE broadcasts it if it is small, and otherwise joins by
    shuffle. Rows with a null group key, or whose group has no value, keep the null.
    """
    keys = [*scope, group_col]
    return _filled(df, group_mode(df, keys, target), keys, target)


def _filled(df: DataFrame, modes: DataFrame, keys: Sequence[str], target: str) -> DataFrame:
    filled = F.coalesce(F.col(target), F.col("__mode"))
    return df.join(modes, list(keys), "left").withColumn(target, filled).drop("__mode").select(*df.columns)


def impute_counting_nulls(df: DataFrame, group_col: str, target: str, scope: Sequence[str] = ("week_start",)) -> DataFrame:
    """The variant in which nulls count as a value: a group whose most frequent value is null stays
    unfilled. On a tie a null comes last, then the smallest value wins."""
    keys = [*scope, group_col]
    counts = df.groupBy(*keys, target).agg(F.count("*").alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("rank"), F.col(target).isNull().alias("none"), F.col(target).alias("value")))
    modes = counts.groupBy(*keys).agg(best.alias("best")).select(*keys, F.col("best.value").alias("__mode"))
    return _filled(df, modes, keys, target)


def impute(df: DataFrame, steps: Iterable[tuple[str, str]] = IMPUTE_STEPS, scope: Sequence[str] = ("week_start",)) -> DataFrame:
    """All steps; each sees what earlier ones filled.

    The steps are played through on the distinct combinations of keys and targets with their
    counts, a frame of few rows, by windows; then every row looks up its own combination. So rows
    are read twice and joined once, however many steps there are.
    """
    steps = list(steps)
    targets = list(dict.fromkeys(t for _, t in steps))
    others = [c for c in dict.fromkeys([*scope, *[g for g, _ in steps]]) if c not in targets]
    combos = df.groupBy(*others, *targets).agg(F.count("*").alias("__n")).withColumns({f"__was_{t}": F.col(t) for t in targets})
    for group_col, target in steps:
        keys = [*scope, group_col]
        known = reduce(and_, [F.col(k).isNotNull() for k in keys])
        rows = F.sum("__n").over(Window.partitionBy(*keys, target))
        pick = F.when(F.col(target).isNotNull(), F.struct((-F.col("__rows")).alias("rank"), F.col(target).alias("value")))
        mode = F.min(pick).over(Window.partitionBy(*keys))["value"]
        combos = combos.withColumn("__rows", rows).withColumn("__mode", mode)
        combos = combos.withColumn(target, F.coalesce(target, F.when(known, F.col("__mode")))).drop("__rows", "__mode")
    same = [F.col(f"d.{c}").eqNullSafe(F.col(f"m.{c}")) for c in others] + [F.col(f"d.{t}").eqNullSafe(F.col(f"m.__was_{t}")) for t in targets]
    joined = df.alias("d").join(combos.alias("m"), reduce(and_, same), "left")
    return joined.select(*[F.col(f"m.{c}" if c in targets else f"d.{c}") for c in df.columns])


def fill_unknown(df: DataFrame, columns: Sequence[str] | None = ("category_code", "brand")) -> DataFrame:
    """Nulls become "unknown": in the imputed columns, or with None in every string column."""
    return df.na.fill("unknown") if columns is None else df.na.fill("unknown", subset=list(columns))


def split_category(df: DataFrame, column: str = "category_code", names: Sequence[str] = ("category_lv_1", "category_lv_2", "category_lv_3"), missing: str = "none") -> DataFrame:
    """Levels of a dotted path. "unknown" gives unknown levels; the first has no default."""
    parts = F.split(F.col(column), r"\.")
    unknown = F.col(column) == "unknown"
    level = lambda i: F.get(parts, i) if i == 0 else F.coalesce(F.get(parts, i), F.lit(missing))
    return df.withColumns({n: F.when(unknown, "unknown").otherwise(level(i)) for i, n in enumerate(names)})


def parse_time(df: DataFrame, column: str = "event_time") -> DataFrame:
    """Text (a trailing UTC is fine) to a timestamp, its date and its time of day."""
    t = F.to_timestamp(F.regexp_replace(F.col(column), " UTC$", "")).cast("timestamp_ntz")
    return df.withColumn(column, t).withColumns({f"{column}_ymd": F.to_date(column), f"{column}_hms": F.date_format(column, "HH:mm:ss")})


def time_parts(df: DataFrame, column: str = "event_time") -> DataFrame:
    """ymd, hms and the zero-padded month, day and hour, and the short day name."""
    formats = {"hms": "HH:mm:ss", "month": "MM", "day": "dd", "hour": "HH", "day_name": "E"}
    return df.withColumn(f"{column}_ymd", F.to_date(column)).withColumns(
        {f"{column}_{n}": F.date_format(column, f) for n, f in formats.items()}
    )


def clean_events(df: DataFrame, anchor: str = "2024-01-01", scope: Sequence[str] = ("week_start",)) -> DataFrame:
    """Raw events to the 18 fixed columns; imputation stays within a week unless scope says otherwise."""
    timed = df.filter(F.col("event_time").isNotNull()).withColumn("week_start", bin_start("event_time", anchor))
    return split_category(time_parts(fill_unknown(impute(timed, scope=scope)))).select(*RAW_COLUMNS)
