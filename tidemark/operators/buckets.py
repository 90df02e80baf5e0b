"""Bucketed tables: FACT and the product dimension lie in equal buckets of product_id, sorted by it.

The staging join of such tables needs no shuffle of events and no sort: bucket meets bucket. Of the
other lookups, time columns are functions of time_id, and categories, a row for each category of
the catalogue, are broadcast as long as their count is small, else joined by a shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.clean import time_parts

#: Rows of categories that are broadcast.
SMALL_ROWS = 200_000


def save(df: DataFrame, table: str, key: str, buckets: int) -> DataFrame:
    """Write df as a table in ``buckets`` buckets of key. A key that holds much of the table fills its bucket's
    one file, so this is for keys that are spread; rows go to their bucket in one shuffle, at writing."""
    df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).format("parquet").mode("overwrite").saveAsTable(table)
    return df.sparkSession.table(table)


def staging(spark: SparkSession, fact: str, product: str, category: DataFrame) -> DataFrame:
    """The staging columns from tables ``fact`` and ``product`` that ``save`` wrote by product_id."""
    events = spark.table(fact).join(spark.table(product), "product_id", "left")
    few = category.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS
    named = events.join(F.broadcast(category) if few else category, "category_id", "left")
    return time_parts(named.withColumn("event_time", F.timestamp_micros("time_id").cast("timestamp_ntz")))
