"""Exact positions in a total order, and dense ids from them, without a task that sees all rows.

Rows are range-partitioned by the order and sorted within partitions; a row's position is its place
in its partition plus the rows of earlier partitions. That is one shuffle. Ties are no matter as
long as the order ends in a column that tells rows apart: then the ranges cut through ties too.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import written

#: Rows of a range, about; Spark's shuffle partitions bound the number of ranges.
RANGE_ROWS = 50_000
_PLACE = (1 << 33) - 1  # monotonically_increasing_id: partition above, place within below


def positions(df: DataFrame, order: Sequence[str], name: str = "position", settled: bool = False) -> DataFrame:
    """df with the position (from 1) of each row in ascending order of the columns, nulls first.

    The sorted rows are written once, so partition and place of a row don't change when an executor
    is lost; ``settled`` says that df is a written table, or little work on one, and can be read twice.
    Rows that are equal in all order columns get neighbouring positions in no set order.
    """
    source = df if settled else written(df, "unranked")
    shuffles = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = max(1, min(shuffles, -(-source.count() // RANGE_ROWS)))
    dealt = source.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    placed = written(dealt.withColumn("__at", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("__at", 33).alias("__part")
    ahead = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    before = placed.groupBy(part).agg(F.count("*").alias("__n")).select("__part", F.coalesce(F.sum("__n").over(ahead), F.lit(0)).alias("__before"))
    at = F.col("__before") + F.col("__at").bitwiseAND(F.lit(_PLACE)) + 1
    return placed.withColumn("__part", part).join(F.broadcast(before), "__part").withColumn(name, at).drop("__at", "__part", "__before")


def dense_ids(df: DataFrame, keys: Sequence[str], name: str, after: int = 0) -> DataFrame:
    """df with ids after+1, after+2, ... by ascending keys: unique, and without gaps."""
    return positions(df, keys, name).withColumn(name, F.col(name) + F.lit(after).cast("long"))


def ntile(position: Column, n: Column, tiles: int = 5) -> Column:
    """The tile (from 1) of a position among n: the first n mod tiles tiles hold one row more."""
    small, extra = F.floor(n / tiles), n % tiles
    edge = extra * (small + 1)
    late = extra + F.floor((position - 1 - edge) / F.greatest(small, F.lit(1)))
    return F.when(position <= edge, F.floor((position - 1) / (small + 1))).otherwise(late) + 1
