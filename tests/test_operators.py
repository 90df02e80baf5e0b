import pytest
from pyspark.sql import functions as F

from tidemark.functions import clean as C
from tidemark.operators import quality, star, upsert
from tidemark.plans import catalog
from tidemark.plans import metrics as M
from tests.oracle import DATA

T = "timestamp_ntz"


def events(spark, rows):
    df = spark.createDataFrame(rows, "user_id string, user_session string, t string, event_type string, product_id string, price double")
    return df.withColumn("event_time", F.col("t").cast(T)).drop("t")


def test_upserts_and_null_keys(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (None, "x")], "k int, v string")
    new = spark.createDataFrame([(2, "B"), (3, "c"), (None, "y")], "k int, v string")
    assert sorted(map(tuple, upsert.insert_only(old, new, ["k"]).collect()), key=str) == sorted(
        [(1, "a"), (2, "b"), (None, "x"), (3, "c"), (None, "y")], key=str
    )
    assert sorted(map(tuple, upsert.update_insert(old, new, ["k"]).collect()), key=str) == sorted(
        [(1, "a"), (2, "B"), (None, "x"), (3, "c"), (None, "y")], key=str
    )
    with pytest.raises(ValueError):
        upsert.unique(new.union(new), ["k"])


def test_conversion_without_views_is_null(spark):
    ev = events(spark, [("u", "s", "2024-01-01 00:00:00", "purchase", "p", 1.0), ("u", "s", "2024-01-02 00:00:00", "cart", "p", 1.0)])
    got = {str(r.event_time_ymd): r.conversion_rate_percentage for r in M.conversion_rate(ev).collect()}
    assert got == {"2024-01-01": None, "2024-01-02": None}


@pytest.mark.parametrize("n", [0, 1, 3, 5, 7, 12, 23])
def test_scores_equal_ntile(spark, n):
    rows = [(f"u{i:02}", "s", f"2024-01-{1 + i % 4:02} 00:00:00", "purchase", "p", float(i % 3)) for i in range(n)]
    ev = events(spark, rows)
    got = {r.user_id: (r.recency_score, r.frequency_score, r.monetary_score) for r in M.rfm(ev).collect()}
    M.rfm(ev).createOrReplaceTempView("scored")
    want = spark.sql(
        "select user_id, 6 - ntile(5) over (order by recency, user_id) r, 6 - ntile(5) over (order by frequency desc, user_id) f, "
        "6 - ntile(5) over (order by monetary desc, user_id) m from scored"
    )
    assert got == {r.user_id: (r.r, r.f, r.m) for r in want.collect()} and len(got) == n


@pytest.mark.parametrize("prefix", ["", "user-000", "ü"])
def test_scores_when_most_users_tie(spark, prefix):
    """90 % bought once for one price: cuts within the tie go by user_id."""
    rows = [(f"{prefix}{i:05}", "s", f"2024-01-{1 + (i % 10 == 0) * (i % 7):02} 00:00:00", "purchase", "p", 1.0) for i in range(500)]
    rows += [(f"{prefix}{i:05}", "s", "2024-01-02 00:00:00", "purchase", "p", 2.0) for i in range(0, 500, 10)]
    rows += [(f"{prefix}{i:05}", "s", "2024-01-09 00:00:00", "view", "p", 9.0) for i in range(490, 600)]
    scored = M.rfm(events(spark, rows)).toPandas().sort_values("user_id").reset_index(drop=True)
    assert len(scored) == 500
    for name, ascending in (("recency", True), ("frequency", False), ("monetary", False)):
        order = scored.sort_values([name, "user_id"], ascending=[ascending, True]).index
        want = {row: 5 - at // 100 for at, row in enumerate(order)}
        assert scored[f"{name}_score"].to_dict() == want, name


def test_orphans(spark):
    fact = spark.createDataFrame([(1,), (2,), (None,), (2,)], "k int")
    assert sorted((r.k for r in quality.orphans(fact, fact.filter("k = 1"), "k").collect()), key=str) == [2, 2, None]
    assert quality.orphans(fact, fact, "k").count() == 1  # a null key finds nothing


def test_times_within_a_second_have_ids_of_their_own(spark):
    df = spark.sql("select timestamp_ntz '2024-01-01 00:00:00.1' as event_time union all select timestamp_ntz '2024-01-01 00:00:00.2'")
    clean = C.time_parts(df)
    assert quality.duplicate_keys(star.time_dim(clean), ["time_id"]).count() == 0 and star.time_dim(clean).count() == 2


def test_star_keys_are_unique_and_facts_have_no_orphans(spark):
    c = catalog.cleaned(spark, DATA)
    dims = {"time_id": star.time_dim(c), "category_id": star.category_dim(c), "product_id": star.product_dim(c)}
    f = star.fact(c)
    for key, dim in dims.items():
        assert quality.duplicate_keys(dim, [key]).count() == 0
        assert quality.orphans(f, dim, key).count() == 0
    assert star.staging(f, dims["category_id"], dims["product_id"], dims["time_id"]).count() == c.count()
    assert f.select("event_id").distinct().count() == f.count()
    assert c.filter("category_code is null or brand is null").count() == 0


def test_category_with_two_codes_does_not_fan_out(spark):
    rows = [("c", "a.b", "a", "b", "none")] * 2 + [("c", "a.z", "a", "z", "none")]
    df = spark.createDataFrame(rows, "category_id string, category_code string, category_lv_1 string, category_lv_2 string, category_lv_3 string")
    assert [r.category_code for r in star.category_dim(df).collect()] == ["a.b"]


def test_weeks_between_sunday_and_monday(spark):
    ev = events(spark, [("u", "s", "2019-10-06 00:00:00", "view", "p", 1.0), ("u", "s", "2019-10-07 00:00:00", "view", "p", 1.0)])
    got = {(r.week_number, r.retention_rate_percentage) for r in M.retention_weekly(ev).collect()}
    assert got == {(0, 100.0), (1, 100.0)}
