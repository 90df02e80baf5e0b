"""Ranks, ids, merges and loads: against brute force, full recomputation, and loads that break off."""

import random
from collections import Counter

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from tests.oracle import DATA, rows
from tidemark.functions import clean as C
from tidemark.operators import bitmaps, star, upsert
from tidemark.operators.rank import dense_ids, positions
from tidemark.plans import catalog, pipeline, refresh
from tidemark.plans import metrics as M
from tidemark.session import written
from tidemark.sources.fixtures import fx_events

# ranks --------------------------------------------------------------------------------------


@pytest.mark.parametrize("n", [0, 1, 999])
def test_positions(spark, monkeypatch, n):
    """90 % tie on the first column, and one id is unlike all others."""
    monkeypatch.setattr("tidemark.operators.rank.RANGE_ROWS", 100)
    data = [(0 if i % 10 else i, f"user-{i:05}") for i in range(n - 1)] + ([(0, "a")] if n else [])
    random.Random(n).shuffle(data)
    df = spark.createDataFrame(data, "k int, id string").repartition(3)
    got = positions(df, ["k", "id"]).collect()
    assert {(r.k, r.id): r.position for r in got} == {row: i for i, row in enumerate(sorted(data), 1)}
    if n > 100:  # ties are cut, no part holds them all
        made = []
        monkeypatch.setattr("tidemark.operators.rank.written", lambda df, tag: made.append(written(df, tag)) or made[-1])
        positions(df, ["k", "id"])
        parts = made[-1].groupBy(F.shiftright("__at", 33).alias("part")).count().collect()
        assert len(parts) == 4 and max(r["count"] for r in parts) < 0.5 * n


def test_dense_ids_of_nulls_and_neighbours(spark):
    data = [(None, "x"), ("x", None), (None, None), ("x", "x"), ("", None), (None, "")]
    got = dense_ids(spark.createDataFrame(data, "a string, b string"), ["a", "b"], "id", after=10).collect()
    assert sorted(r.id for r in got) == list(range(11, 17)) and {(r.a, r.b) for r in got} == set(data)


# merge --------------------------------------------------------------------------------------


def merged(target, source, update, null_safe):
    """Rows and actions by the definition, row by row."""
    match = lambda a, b: a == b and (null_safe or a is not None)
    out = [(k, v, "kept") for k, v in target if not update or not any(match(k, s) for s, _ in source)]
    for k, v in source:
        hit = any(match(k, t) for t, _ in target)
        if update or not hit:
            out.append((k, v, "updated" if hit else "inserted"))
    return Counter(out)


@pytest.mark.parametrize("update", [True, False])
@pytest.mark.parametrize("null_safe", [True, False])
def test_merge(spark, update, null_safe):
    rng = random.Random(update * 2 + null_safe)
    for _ in range(3):
        target = [(rng.choice([None, *range(9)]), f"t{i}") for i in range(rng.randint(0, 9))]
        source = [(k, f"s{k}") for k in rng.sample([None, *range(9)], rng.randint(0, 9))]
        seen = Observation()
        f = lambda data: spark.createDataFrame(data, "k int, v string")
        got = Counter(map(tuple, upsert.merge(f(target), f(source), ["k"], update, null_safe, counts=seen).collect()))
        want = merged(target, source, update, null_safe)
        assert got == want
        by = Counter()
        for (_, _, action), n in want.items():
            by[action] += n
        assert seen.get == {a: by[a] for a in ("kept", "updated", "inserted")}


def test_merge_refuses_or_takes_several_rows(spark):
    f = lambda data: spark.createDataFrame(data, "k int, v string")
    target, source = f([(1, "a")]), f([(1, "b"), (2, "c"), (2, "d")])
    for update, several in ((True, False), (True, True), (False, False)):
        with pytest.raises(Exception, match="several rows for one key"):
            upsert.merge(target, source, ["k"], update, several=several).collect()
    got = upsert.merge(target, source, ["k"], update=False, several=True).collect()
    assert Counter(map(tuple, got)) == Counter([(1, "a", "kept"), (2, "c", "inserted"), (2, "d", "inserted")])
    nulls = f([(None, "b"), (None, "c")])  # null keys never match, so they are no twins
    assert upsert.merge(target, nulls, ["k"], update=True).count() == 3


def test_merge_shuffles_both_sides_once(spark):
    a, b = written(spark.range(10).withColumn("v", F.lit(1)), "a"), written(spark.range(5, 20).withColumn("v", F.lit(2)), "b")
    df = upsert.merge(a, b, ["id"], update=True)
    assert df._jdf.queryExecution().sparkPlan().toString().count("Join") == 0
    df.collect()
    assert df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("Exchange hashpartitioning") == 1


@pytest.mark.parametrize("name", sorted(catalog.FEEDS))
def test_feeds_keep_and_insert(spark, name):
    """Returning target, source or their union isn't the merge."""
    f, keys, frame, old, new = catalog.FEEDS[name]
    target, source = (f(frame(spark, DATA).filter(w)).toPandas() for w in (old, new))
    got = catalog.QUERIES[f"merge_actions_{name}"](spark, DATA).toPandas()
    assert set(got.action) == {"kept", "inserted"}
    mine = rows(got.drop(columns="action"))
    assert mine != rows(target) and mine != rows(source) and mine != rows(target) + rows(source)
    assert len(set(map(tuple, source[keys].values)) & set(map(tuple, target[keys].values)))


# loads --------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def clean(spark):
    return written(C.clean_events(catalog.holed(fx_events(spark, DATA)), "2024-01-01"), "clean").cache()


def same(spark, root, names=tuple(pipeline.ANALYSIS)):
    ev = pipeline.staging(spark, root)
    for name, df in ((n, df) for n, df in pipeline.full_refresh(spark, root).items() if n in names):
        got, want = pipeline.table(spark, root, name).toPandas(), df.toPandas()
        assert len(want) and rows(got) == rows(want), name
    return ev


def test_loads_in_any_order_equal_a_full_refresh(spark, tmp_path, clean):
    """Days are dealt to loads at random, so that users' first days, weeks and months change late; events without user, session or product."""
    root = str(tmp_path)
    load = F.pmod(F.xxhash64(F.to_date("event_time")), F.lit(3))
    for k in range(3):
        pipeline.run_load(spark, root, clean.filter(load == k))
    ev = same(spark, root)
    assert ev.count() == clean.count()
    ids = sorted(r[0] for r in upsert.current(spark, root, "fact").select("event_id").collect())
    assert ids == list(range(1, clean.count() + 1))


def test_a_load_writes_what_it_touches(spark, tmp_path, clean):
    root = str(tmp_path)
    early = clean.filter("event_time < '2024-01-15'")
    pipeline.run_load(spark, root, early)
    before = pipeline.table(spark, root, "dau").toPandas()
    wrote = pipeline.run_load(spark, root, clean.filter("event_time >= '2024-01-15' and event_time < '2024-01-16'"))
    assert wrote["dau"] == wrote["conversion_rate"] == wrote["count_visitors"] == wrote["purchased_order"] == 1
    assert wrote["mau"] == wrote["stickiness"] == wrote["wau"] == 1 and wrote["funnel"] <= 5
    assert wrote["retention_daily"] < len(pipeline.table(spark, root, "retention_daily").toPandas())
    after = pipeline.table(spark, root, "dau").toPandas()
    assert rows(before) < rows(after) and len(after) == len(before) + 1
    again = pipeline.run_load(spark, root, early)  # known events: nothing but the whole tables
    assert all(n == 0 for name, n in again.items() if name not in refresh.WHOLE) and set(again) == set(refresh.WHOLE)
    same(spark, root, ("active_users", "retention_daily", "monthly_price_event_type", "rfm_combined"))


def test_a_load_leaves_no_intermediates(spark, tmp_path, clean):
    from tidemark.session import shared_path
    from tidemark.sources.events import list_folders

    folder = shared_path(spark, "x").rsplit("/", 1)[0]
    before = list_folders(spark, folder)
    pipeline.run_load(spark, str(tmp_path), clean.filter("event_time < '2024-01-03'"))
    assert list_folders(spark, folder) == before and pipeline.staging(spark, str(tmp_path)).count()


def seen(spark, root):
    star_ = {n: upsert.current(spark, root, n).count() for n in ("time_dim", "user_dim", "category_dim", "product_dim", "fact")}
    return star_ | {"staging": pipeline.staging(spark, root).count(), "dau": rows(pipeline.table(spark, root, "dau").toPandas())}


@pytest.mark.parametrize("at", ["tidemark.operators.star.with_event_ids", "tidemark.plans.refresh.dau"])
def test_a_load_that_breaks_off_is_not_seen(spark, tmp_path, clean, monkeypatch, at):
    """Killed between dimensions and FACT, or among the results: readers see the load before, whole."""
    root = str(tmp_path)
    early, late = clean.filter("event_time < '2024-01-10'"), clean.filter("event_time >= '2024-01-10' and event_time < '2024-01-20'")
    pipeline.run_load(spark, root, early)
    before = seen(spark, root)

    def killed(*_, **__):
        raise RuntimeError("killed")

    with monkeypatch.context() as m:
        if at.endswith("dau"):
            m.setitem(refresh.RESULTS, "dau", (killed, ["event_date"]))
        else:
            m.setattr(at, killed)
        with pytest.raises(RuntimeError):
            pipeline.run_load(spark, root, late)
    assert seen(spark, root) == before
    pipeline.run_load(spark, root, late)
    same(spark, root, ("dau", "stickiness", "retention_weekly", "purchased_order"))
    assert seen(spark, root)["fact"] == before["fact"] + late.count() == upsert.current(spark, root, "fact").select("event_id").distinct().count()


def test_reload_with_null_keys(spark, tmp_path, clean):
    root = str(tmp_path)
    for _ in range(2):
        pipeline.load(spark, root, clean)
    assert upsert.current(spark, root, "fact").count() == clean.count()
    assert upsert.current(spark, root, "user_dim").count() == clean.select("user_id", "user_session").distinct().count()
    assert upsert.current(spark, root, "product_dim").count() == clean.select("product_id").distinct().count()


def test_equal_events_count_as_often_as_they_occur(spark):
    base = spark.sql("select timestamp_ntz '2024-01-01' event_time, 'c' category_id, cast(null as string) product_id, 'u' user_id, 's' user_session, 'view' event_type")
    other = base.withColumns({"product_id": F.lit("u"), "user_id": F.lit(None).cast("string")})  # the same values, one column on
    three = base.unionByName(base).unionByName(base).unionByName(other)
    assert star.new_facts(star.fact_rows(base), three).count() == 3 and star.new_facts(star.fact_rows(three), base).count() == 0
    assert star.fact(three).select("event_id").distinct().count() == 4


def test_a_window_of_staging_reads_its_weeks_only(spark, tmp_path, clean):
    root = str(tmp_path)
    run = upsert.Load(spark, root)
    pipeline.write_staging(run, pipeline.write_star(run, clean))
    run.commit()
    df = pipeline.staging(spark, root, "2024-01-10", "2024-01-12")
    assert df.count() == clean.filter("event_time >= '2024-01-10' and event_time < '2024-01-13'").count()
    files = {r[0] for r in df.select(F.input_file_name()).distinct().collect()}
    assert files and all("week_start=2024-01-08" in f for f in files)
    assert "PartitionFilters: [isnotnull(week_start" in df._jdf.queryExecution().toString()


def test_grains_come_from_one_scan(spark):
    ev = written(fx_events(spark, DATA), "events")
    for f in (M.active_users, M.active_users_full):
        assert f(ev)._jdf.queryExecution().sparkPlan().toString().count("Scan") == 1


def test_bitmap_ids_stay(spark):
    keys = lambda *k: spark.createDataFrame([(x,) for x in k], "u string")
    first = written(bitmaps.id_map(keys("b", "d", None, "b"), "u"), "ids")
    ids = {r.u: r.id for r in bitmaps.id_map(keys("a", "d", "e"), "u", first).collect()}
    assert ids == {"b": 1, "d": 2, "a": 3, "e": 4}
    pairs = spark.createDataFrame([("x", "a"), ("x", "b"), ("y", "b"), ("y", None), ("y", "e")], "day string, u string")
    days = bitmaps.daily(pairs, bitmaps.id_map(keys("a", "d", "e"), "u", first), "u", "day")
    assert {r.day: r.n for r in bitmaps.counts(days, "day", "n").collect()} == {"x": 2, "y": 2}
    assert bitmaps.counts(bitmaps.rolled(days, F.lit("all"), "g"), "g", "n").first().n == 3


def test_bucketed_staging_shuffles_no_events(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = catalog.bucketed(spark, DATA)
        assert df.count() == fx_events(spark, DATA).count()
        plan = df._jdf.queryExecution().sparkPlan().toString()
        assert "SortMergeJoin" in plan
        df.collect()
        ran = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
        assert "Exchange hashpartitioning" not in ran and "BroadcastExchange" in ran  # the small category lookup
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
