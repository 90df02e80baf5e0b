"""Exact, mergeable distinct counts: bitmaps over dense ids, kept for each day.

A bitmap holds a bit for each id of a bucket (32,768 ids, 4 KB). Ids are dense, so n users take n/8
bytes a day at most, however their own keys look. Weeks and months are unions (or_agg) of their
days' bitmaps, without another look at the events.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.rank import dense_ids


def id_map(keys: DataFrame, key: str, known: DataFrame | None = None) -> DataFrame:
    """key, id: the known map, and ids behind its highest for keys that it doesn't hold. Null has none."""
    new = keys.select(key).filter(F.col(key).isNotNull()).distinct()
    if known is None:
        return dense_ids(new, [key], "id")
    last = known.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    return known.unionByName(dense_ids(new.join(known.select(key), key, "left_anti"), [key], "id", last))


def daily(pairs: DataFrame, ids: DataFrame, key: str, day: str) -> DataFrame:
    """day, bucket, bits of the keys (with an id) that pairs has on each day."""
    coded = pairs.select(day, key).distinct().join(ids, key).select(day, F.col("id"))
    bucket = F.bitmap_bucket_number("id")
    return coded.groupBy(day, bucket.alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("id")).alias("bits"))


def rolled(bitmaps: DataFrame, by: Column, name: str) -> DataFrame:
    """The bitmaps of coarser bins."""
    return bitmaps.groupBy(by.alias(name), "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))


def counts(bitmaps: DataFrame, by: str, name: str) -> DataFrame:
    return bitmaps.groupBy(by).agg(F.sum(F.bitmap_count("bits")).alias(name))
