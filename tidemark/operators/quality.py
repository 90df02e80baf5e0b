"""Profiles and checks; each is one pass, nothing is collected."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def null_profile(df: DataFrame) -> DataFrame:
    """column_name, nulls, rows: all columns counted in one pass."""
    counts = df.agg(F.count("*").alias("rows"), *[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("nulls")) for c in df.columns])
    return counts.select(F.explode(pairs).alias("p"), "rows").select("p.column_name", "p.nulls", "rows")


def shape(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("n_rows")).withColumn("n_columns", F.lit(len(df.columns)).cast("long"))


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("cnt")).filter("cnt > 1")


def value_share(df: DataFrame, column: str) -> DataFrame:
    """value, count, percent of all rows; the total is one row, joined to each value."""
    counts = df.groupBy(column).agg(F.count("*").alias("cnt"))
    total = counts.agg(F.sum("cnt").alias("__total"))
    share = F.round(F.col("cnt").cast("double") * 100 / F.col("__total"), 2)
    return counts.crossJoin(F.broadcast(total)).withColumn("pct", share).drop("__total")


def key_cardinality(df: DataFrame, key: str, column: str, above: int = 2) -> DataFrame:
    """Keys with more than ``above`` distinct values, a null counting as one."""
    n = F.countDistinct(F.coalesce(F.col(column), F.lit("NULL")))
    return df.groupBy(key).agg(n.alias("n_values")).filter(F.col("n_values") > above)


def first_fill(df: DataFrame, key: str, column: str) -> DataFrame:
    """Nulls filled with the key's smallest value, which doesn't depend on row order."""
    low = df.groupBy(key).agg(F.min(column).alias("__low"))
    return df.join(low, key, "left").withColumn(column, F.coalesce(column, "__low")).select(*df.columns)


def orphans(fact: DataFrame, dim: DataFrame, key: str) -> DataFrame:
    """Fact rows with a key that the dimension lacks (a null key counts)."""
    return fact.join(dim.select(key).distinct(), key, "left_anti")


def value_range(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.agg(*[f(c).alias(f"{n}_{c}") for c in columns for n, f in (("min", F.min), ("max", F.max))])
