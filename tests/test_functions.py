import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.functions import clean as C
from tidemark.functions import dates as D


def one(spark, a, b, f):
    df = spark.createDataFrame([(a, b)], "a string, b string").select(F.to_timestamp("a").alias("a"), F.to_timestamp("b").alias("b"))
    return df.select(f("a", "b")).first()[0]


@pytest.mark.parametrize(
    ("f", "a", "b", "want"),
    [
        (D.day_steps, "2024-01-01 23:00:00", "2024-01-02 01:00:00", 1),
        (D.week_steps, "2019-10-06 12:00:00", "2019-10-07 00:00:00", 1),
        (D.week_steps, "2019-10-07 00:00:00", "2019-10-13 23:59:59", 0),
        (D.month_steps, "2019-10-31 00:00:00", "2019-11-01 00:00:00", 1),
        (D.month_steps, "2019-12-31 00:00:00", "2020-01-01 00:00:00", 1),
    ],
)
def test_steps(spark, f, a, b, want):
    assert one(spark, a, b, f) == want


def test_bins(spark):
    days = ["2019-09-30", "2019-10-01", "2019-10-07", "2019-10-08"]
    df = spark.createDataFrame([(x,) for x in days], "d string").select(D.bin_start("d").cast("string"))
    assert [r[0] for r in df.collect()] == ["2019-09-24", "2019-10-01", "2019-10-01", "2019-10-08"]


def test_window_keeps_the_last_day(spark):
    rows = [("2019-11-25 00:00:00",), ("2019-11-25 00:00:01",), ("2019-11-26 00:00:00",)]
    df = spark.createDataFrame(rows, "t string").select(F.col("t").cast("timestamp_ntz").alias("t"))
    assert df.filter(D.in_window(F.col("t"), "2019-10-01", "2019-11-25")).count() == 2
    assert df.filter(D.in_window(F.col("t"), "2019-10-01", "2019-11-25", inclusive_midnight=True)).count() == 1


def test_date_slice_needs_a_ymd_column(spark):
    with pytest.raises(ValueError):
        D.date_slice(spark.range(1), "2024-01-01", "2024-01-02")


EV = "week_start string, product_id string, category_id string, category_code string, brand string"


def test_impute_ties_nulls_and_scope(spark):
    rows = [
        ("w1", "p1", "c1", "b", None), ("w1", "p1", "c1", "b", None), ("w1", "p1", "c1", "a", None), ("w1", "p1", "c1", "a", None),
        ("w1", "p1", "c1", None, None), ("w1", None, "c1", None, None), ("w2", "p1", "c1", None, None), ("w1", "p2", None, None, None),
    ]
    got = C.impute_by_mode(spark.createDataFrame(rows, EV), "product_id", "category_code").collect()
    by = {(r.week_start, r.product_id): r.category_code for r in got if r.category_code in (None, "a")}
    assert by[("w1", "p1")] == "a"  # the smaller of a tie
    assert by[("w2", "p1")] is None  # another week
    assert by[("w1", None)] is None and by[("w1", "p2")] is None
    assert len(got) == len(rows)
    chain = C.impute(spark.createDataFrame(rows, EV), scope=())
    assert chain.filter("category_code is null").count() == 1  # only the row without any filled group


def test_fill_unknown_touches_only_its_columns(spark):
    df = spark.createDataFrame([(None, None, None)], "category_code string, brand string, user_session string")
    assert tuple(C.fill_unknown(df).first()) == ("unknown", "unknown", None)
    assert tuple(C.fill_unknown(df, None).first()) == ("unknown",) * 3


def test_split_category(spark):
    rows = [("a.b.c",), ("a.b",), ("a",), ("unknown",), (None,), ("a.b.c.d",)]
    got = [tuple(r)[1:] for r in C.split_category(spark.createDataFrame(rows, "category_code string")).collect()]
    assert got == [("a", "b", "c"), ("a", "b", "none"), ("a", "none", "none"), ("unknown",) * 3, (None, "none", "none"), ("a", "b", "c")]


def test_parse_time(spark):
    df = spark.createDataFrame([("2019-10-01 00:00:07 UTC",), ("2019-10-01 23:59:59",)], "event_time string")
    got = C.parse_time(df).collect()
    assert got[0].event_time == dt.datetime(2019, 10, 1, 0, 0, 7) and got[1].event_time_hms == "23:59:59"


def test_time_parts(spark):
    df = spark.sql("select timestamp_ntz '2019-10-01 04:05:06' as event_time")
    r = C.time_parts(df).first()
    assert (r.event_time_month, r.event_time_day, r.event_time_hour, r.event_time_day_name, r.event_time_hms) == ("10", "01", "04", "Tue", "04:05:06")
