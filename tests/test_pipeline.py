import datetime as dt
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tests.oracle import DATA, rows
from tidemark.operators.upsert import append, current, paths, prune, publish
from tidemark.plans import pipeline, weeks
from tidemark.plans.state import State
from tidemark.sources import events as E
from tidemark.sources.fixtures import fx_events


def test_week_list():
    got = weeks.week_list("2019-10-01", "2019-10-15")
    assert got["week_1"] == {"weekly_start_date": "2019-10-01", "weekly_end_date": "2019-10-07"}
    assert got["week_3"]["weekly_end_date"] == "2019-10-21" and len(got) == 3
    assert weeks.week_list("2019-10-02", "2019-10-01") == {}


def test_dates_and_folders():
    assert weeks.parse_date("191001") == weeks.parse_date("2019-10-01") == dt.date(2019, 10, 1)
    with pytest.raises(ValueError):
        weeks.parse_date("01/10/2019")
    assert weeks.folder("raw", "2019-10-01") == ("raw/191001/", "2019-10-07")


def test_run_window():
    assert weeks.run_window("2019-12-03") == {"start_date": "2019-11-26", "end_date": "2019-12-02", "next_date": "2019-12-10"}


def test_state(spark, tmp_path):
    s = State(spark, str(tmp_path))
    assert s.get() == {"run_state": "pending", "current_date": "2019-12-03"}
    s.reset()
    s.done()
    assert s.get() == {"run_state": "done", "current_date": "2019-12-10"}
    s.reset()  # not pending, nothing changes
    assert s.window()["start_date"] == "2019-12-03"


def test_initial_plus_weekly_equals_one_load(spark, tmp_path):
    ev = fx_events(spark, DATA)
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    pipeline.load(spark, a, pipeline.clean_events(ev, "2024-01-01"))
    early, late = "event_time < '2024-01-15'", "event_time >= '2024-01-15'"
    for part in (early, late, late):  # the last week twice
        pipeline.load(spark, b, pipeline.clean_events(ev.filter(part), "2024-01-01"))
    for name in ("fact", "time_dim", "user_dim"):
        x, y = (current(spark, r, name).toPandas() for r in (a, b))
        assert rows(x) == rows(y), name


def test_a_load_appends_only_new_rows(spark, tmp_path):
    root, ev = str(tmp_path), fx_events(spark, DATA)
    early = pipeline.clean_events(ev.filter("event_time < '2024-01-15'"), "2024-01-01")
    late = pipeline.clean_events(ev.filter("event_time >= '2024-01-15'"), "2024-01-01")
    pipeline.load(spark, root, early)
    (full,) = paths(spark, root, "fact")
    before = {f: f.stat().st_mtime_ns for f in Path(full).iterdir()}
    pipeline.load(spark, root, late)
    parts = paths(spark, root, "fact")
    assert parts[0] == full and len(parts) == 2 and {f: f.stat().st_mtime_ns for f in Path(full).iterdir()} == before
    assert spark.read.parquet(parts[1]).count() == late.count()
    pipeline.load(spark, root, late)
    assert spark.read.parquet(paths(spark, root, "fact")[2]).count() == 0
    publish(current(spark, root, "fact"), root, "fact")
    assert len(prune(spark, root, "fact")) == 3 and current(spark, root, "fact").count() == early.count() + late.count()


def test_a_write_that_breaks_off_leaves_the_old_table(spark, tmp_path):
    root, df = str(tmp_path), spark.range(3)
    publish(df, root, "t")
    for write in (publish, append):
        path = write(spark.range(100), root, "t")
        Path(path, "_SUCCESS").unlink()  # as if the job had died before its commit
        assert current(spark, root, "t").count() == 3
    append(spark.range(2), root, "t")
    assert current(spark, root, "t").count() == 5
    assert current(spark, root, "none") is None


def test_initial_and_weekly_loads_equal_one_load(spark, tmp_path):
    ev = fx_events(spark, DATA).withColumn("event_time", F.col("event_time") - F.expr("interval 48 days"))  # 2024-01-01 is 2023-11-14
    ev = ev.withColumn("event_time", (F.col("event_time") - F.expr("interval 1449 days")))  # now 2019-11-26
    a, b, anchor = str(tmp_path / "a"), str(tmp_path / "b"), "2019-11-26"
    ev = ev.withColumn("event_time", F.col("event_time") - F.expr("interval 7 days"))  # first week 2019-11-19
    pipeline.initial(spark, b, ev, "2019-11-19", "2019-11-25", anchor)
    weeks_ = [pipeline.weekly(spark, b, ev, anchor) for _ in range(2)]
    assert [w["start_date"] for w in weeks_] == ["2019-11-26", "2019-12-03"]
    assert State(spark, b).get() == {"run_state": "done", "current_date": "2019-12-17"}
    pipeline.initial(spark, a, ev, "2019-11-19", "2019-12-09", anchor)
    for name in ("fact", "time_dim", "user_dim"):
        x, y = (current(spark, r, name).toPandas() for r in (a, b))
        assert len(x) and rows(x) == rows(y), name
    for name, key in (("category_dim", "category_id"), ("product_dim", "product_id")):  # a known key keeps the row it first got
        x, y = (current(spark, r, name) for r in (a, b))
        assert x.select(key).exceptAll(y.select(key)).count() == 0 and x.count() == y.count() == y.select(key).distinct().count()
    for name in ("dau", "conversion_rate", "retention_daily", "rfm_combined"):
        x, y = (current(spark, r, name).toPandas() for r in (a, b))
        if name != "rfm_combined":
            assert len(x) and rows(x) == rows(y), name
    assert set(pipeline.ANALYSIS) <= set(E.list_folders(spark, b))


def test_weeks_from_the_listing(spark, tmp_path):
    from tidemark.functions.clean import parse_time

    df = parse_time(spark.createDataFrame([("2019-10-01 00:00:00", 1), ("2019-10-09 00:00:00", 2)], "event_time string, v int"))
    assert E.written_weeks(spark, str(tmp_path / "w")).count() == 0
    E.write_missing_weeks(df.filter("v = 1"), str(tmp_path / "w"), "2019-10-01")
    E.write_missing_weeks(df.withColumn("v", F.lit(9)), str(tmp_path / "w"), "2019-10-01")
    assert [str(r[0]) for r in E.written_weeks(spark, str(tmp_path / "w")).collect()] == ["2019-10-01", "2019-10-08"]
    assert sorted(r.v for r in E.read_weeks(spark, str(tmp_path / "w")).collect()) == [1, 9]


def test_csv_union_and_weeks(spark, tmp_path):
    folder = tmp_path / "csv"
    folder.mkdir()
    head = "event_time,event_type,product_id,category_id,category_code,brand,price,user_id,user_session\n"
    (folder / "2019-Oct.csv").write_text(head + "2019-10-01 00:00:00 UTC,view,1,2,a.b,x,1.5,u,s\n" * 3)
    (folder / "2019-Nov.csv").write_text(head + "2019-11-01 00:00:00 UTC,view,1,2,,,1.5,u,s\n" * 2)
    frames = E.load_csv_folder(spark, str(folder))
    assert set(frames) == {"2019_oct", "2019_nov"}
    assert E.save_union(frames, str(tmp_path / "all")) == 5
    E.save_frames(frames, str(tmp_path / "each"))
    assert E.list_folders(spark, str(tmp_path / "each")) == ["2019_nov", "2019_oct"]
    assert E.path_exists(spark, str(tmp_path / "all")) and not E.path_exists(spark, str(tmp_path / "none"))
    from tidemark.functions.clean import parse_time

    timed = parse_time(spark.read.parquet(str(tmp_path / "all")))
    for _ in range(2):  # a retry replaces, it doesn't append
        E.write_weeks(timed, str(tmp_path / "weeks"), "2019-10-01")
    assert E.read_weeks(spark, str(tmp_path / "weeks")).count() == 5
    assert E.read_weeks(spark, str(tmp_path / "weeks"), ["2019-10-01"]).count() == 3


def test_stream_of_files(spark, tmp_path):
    from tidemark.streaming.incremental import run_available

    folder = tmp_path / "in"
    folder.mkdir()
    head = "event_time,event_type,product_id,category_id,category_code,brand,price,user_id,user_session\n"
    (folder / "a.csv").write_text(head + "2024-01-01 00:00:00 UTC,view,1,2,a.b,x,1.5,u,s\n")
    go = lambda: run_available(spark, str(folder), str(tmp_path / "root"), str(tmp_path / "ck"))
    go()
    (folder / "b.csv").write_text(head + "2024-01-02 00:00:00 UTC,view,1,2,a.b,x,1.5,u,s\n2024-01-01 00:00:00 UTC,view,1,2,a.b,x,1.5,u,s\n")
    go()
    assert current(spark, str(tmp_path / "root"), "fact").count() == 2


def test_windowed_counts_of_a_stream(spark, tmp_path):
    from tidemark.streaming.incremental import event_stream, windowed_counts

    folder = tmp_path / "in"
    folder.mkdir()
    head = "event_time,event_type,product_id,category_id,category_code,brand,price,user_id,user_session\n"
    (folder / "a.csv").write_text(head + "2024-01-04 00:00:00 UTC,view,1,2,a.b,x,1.5,u,s\n" * 3)
    (folder / "b.csv").write_text(head + "2024-03-01 00:00:00 UTC,view,1,2,a.b,x,1.5,u,s\n")
    q = windowed_counts(event_stream(spark, str(folder))).writeStream.format("memory").queryName("counts").outputMode("append")
    q = q.option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert [(str(r.start), r.cnt) for r in spark.table("counts").collect()] == [("2024-01-04 00:00:00", 3)]
