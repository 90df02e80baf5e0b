"""Views that map the test tables onto retail events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fx_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events joined to part: user, session, category, product, brand, price, with nulls."""
    e, p = table(spark, sf_dir, "events"), table(spark, sf_dir, "part")
    key = F.get_json_object("props", "$.k").cast("long")
    lower = F.lower("p_type")
    path = F.when(F.col("p_size") % 3 == 0, F.get(F.split("p_name", " "), 0)).otherwise(F.replace("p_name", F.lit(" "), F.lit(".")))
    user = F.col("user_id").cast("string")
    return e.join(p, key == F.col("p_partkey")).select(
        user.alias("user_id"),
        F.concat(user, F.lit("-"), F.date_format("ts", "yyyyMMdd")).alias("user_session"),
        F.col("p_type").alias("category_id"),
        F.date_trunc("second", "ts").cast("timestamp_ntz").alias("event_time"),
        "event_type",
        F.col("p_partkey").cast("string").alias("product_id"),
        F.when((F.col("p_type") == "PROMO") | (F.col("event_id") % 7 == 0), None).otherwise(F.concat(lower, F.lit("."), path)).alias("category_code"),
        F.when((F.col("p_partkey") % 11 == 0) | (F.col("event_id") % 5 == 0), None).otherwise(F.lower("p_brand")).alias("brand"),
        F.when(F.col("event_id") % 10 == 0, F.round(F.col("p_retailprice") * 0.9, 2)).otherwise(F.col("p_retailprice")).alias("price"),
    )


def fx_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders joined to lineitem and part: purchases over many months."""
    o, l, p = (table(spark, sf_dir, n) for n in ("orders", "lineitem", "part"))
    return (
        o.select("o_orderkey", "o_custkey", "o_orderdate")
        .join(l.select("l_orderkey", "l_partkey", "l_extendedprice"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(p.select("p_partkey", "p_type", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
        .select(
            F.col("o_custkey").cast("string").alias("user_id"),
            F.col("o_orderkey").cast("string").alias("user_session"),
            F.col("o_orderdate").cast("timestamp_ntz").alias("event_time"),
            F.lit("purchase").alias("event_type"),
            F.col("l_partkey").cast("string").alias("product_id"),
            F.col("l_extendedprice").alias("price"),
            F.lower("p_type").alias("category_lv_2"),
            F.lower("p_brand").alias("brand"),
        )
    )
