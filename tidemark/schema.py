"""Schemas of the tables. Ids are strings, event_time carries no time zone."""

from __future__ import annotations

from pyspark.sql import types as T

_S = T.StringType()


def _struct(**kinds: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, k) for n, k in kinds.items()])


# Names, order and types of the tables' columns.
EVENT_CSV = _struct(
    event_time=_S, event_type=_S, product_id=_S, category_id=_S, category_code=_S, brand=_S, price=T.DoubleType(), user_id=_S, user_session=_S
)

RAW = _struct(
    user_id=_S, user_session=_S, category_id=_S, event_time=T.TimestampNTZType(), event_time_ymd=T.DateType(), event_time_hms=_S,
    event_time_month=_S, event_time_day=_S, event_time_hour=_S, event_time_day_name=_S, event_type=_S, product_id=_S,
    category_code=_S, category_lv_1=_S, category_lv_2=_S, category_lv_3=_S, brand=_S, price=T.DoubleType(),
)

TIME_DIM = _struct(
    time_id=T.LongType(), event_time=T.TimestampNTZType(), event_time_ymd=T.DateType(), event_time_hms=_S, event_time_month=_S,
    event_time_day=_S, event_time_hour=_S, event_time_day_name=_S,
)
CATEGORY_DIM = _struct(category_id=_S, category_code=_S, category_lv_1=_S, category_lv_2=_S, category_lv_3=_S)
PRODUCT_DIM = _struct(product_id=_S, brand=_S, price=T.DoubleType())
USER_DIM = _struct(user_id=_S, user_session=_S)
FACT = _struct(
    event_id=T.LongType(), time_id=T.LongType(), category_id=_S, product_id=_S, user_id=_S, user_session=_S, event_type=_S
)

RAW_COLUMNS = RAW.fieldNames()
TIME_COLUMNS = TIME_DIM.fieldNames()[1:]
STAR = {"time_dim": TIME_DIM, "category_dim": CATEGORY_DIM, "product_dim": PRODUCT_DIM, "user_dim": USER_DIM, "fact": FACT}


def reset_tables(spark, root: str) -> None:
    """Empty Parquet tables with the fixed schemas under root (drop and create)."""
    for name, schema in {"raw_data": RAW, **STAR}.items():
        spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{root}/{name}")
