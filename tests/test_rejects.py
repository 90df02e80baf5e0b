"""Loading past bad rows and files, and scripts that fail."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tests.oracle import DATA, check
from tidemark.plans import catalog
from tidemark.plans.sql import run_block
from tidemark.schema import RAW
from tidemark.session import written
from tidemark.sources import rejects

HEAD = "event_time,event_type,product_id,category_id,category_code,brand,price,user_id,user_session\n"
GOOD, BAD = "2019-10-01 00:00:00 UTC,view,1,2,a.b,x,1.5,u,s\n", "2019-10-01 00:00:00 UTC,view,1,2,a.b,x,much,u,s\n"
SHORT = "2019-10-01 00:00:00 UTC,view\n"


def test_csv_lines_that_do_not_fit(spark, tmp_path):
    for name, lines in {"a": GOOD * 3, "b": GOOD + BAD + GOOD + SHORT, "c": BAD, "d": ""}.items():
        (tmp_path / f"{name}.csv").write_text(HEAD + lines)
    rows, bad = rejects.read_csv(spark, str(tmp_path))
    assert rows.count() == 5 and sorted(r.record for r in bad.collect()) == sorted([BAD.strip(), SHORT.strip(), BAD.strip()])
    report = {Path(r.file).stem: (r.status, r.rows_loaded, r.rows_rejected) for r in rejects.csv_report(spark, str(tmp_path), rows, bad).collect()}
    assert report == {"a": ("LOADED", 3, 0), "b": ("PARTIALLY_LOADED", 2, 2), "c": ("LOAD_FAILED", 0, 1), "d": ("LOADED", 0, 0)}


def test_parquet_files_that_break_off(spark, tmp_path):
    clean = catalog.cleaned(spark, DATA).select(*RAW.fieldNames())
    path = str(tmp_path)
    clean.coalesce(1).write.parquet(f"{path}/good")
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "text.parquet").write_bytes(b"hello" * 99)
    (good,) = (tmp_path / "good").glob("*.parquet")
    data = bytearray(good.read_bytes())
    (tmp_path / "bad" / "cut.parquet").write_bytes(bytes(data[: len(data) // 2]))  # no footer
    data[100 : len(data) // 2] = b"\xff" * (len(data) // 2 - 100)  # a footer, but pages that can't be read
    (tmp_path / "bad" / "pages.parquet").write_bytes(bytes(data))
    rows = written(rejects.read_parquet(spark, path), "loaded")
    n = clean.count()
    report = {Path(r.file).stem[:4]: (r.status, r.rows_loaded, r.rows_rejected) for r in rejects.parquet_report(spark, path, rows).collect()}
    assert report["text"] == report["cut"] == ("LOAD_FAILED", 0, None) and report["part"] == ("LOADED", n, 0)
    assert report["page"][0] == "PARTIALLY_LOADED" and report["page"][1] < n and report["page"][1] + report["page"][2] == n
    assert rows.count() == n + report["page"][1]


def test_parquet_files_without_rows_are_no_failures(spark, tmp_path):
    """Empty files, also in folders with glob characters, beside broken ones (F1)."""
    clean = catalog.cleaned(spark, DATA).select(*RAW.fieldNames())
    path = str(tmp_path)
    clean.coalesce(1).write.parquet(f"{path}/good")
    clean.limit(0).write.parquet(f"{path}/empty [1]")
    spark.createDataFrame([], "price string").write.parquet(f"{path}/other")  # another type, no row
    (tmp_path / "bad").mkdir()
    for name in ("a", "b", "c {2}"):
        (tmp_path / "bad" / f"{name}.parquet").write_bytes(b"hello" * 99)
    rows = written(rejects.read_parquet(spark, path), "loaded")
    report = sorted((Path(r.file).parent.name, r.status, r.rows_loaded, r.rows_rejected) for r in rejects.parquet_report(spark, path, rows).collect())
    bad = ("bad", "LOAD_FAILED", 0, None)
    assert report == [bad, bad, bad, ("empty [1]", "LOADED", 0, 0), ("good", "LOADED", clean.count(), 0), ("other", "LOADED", 0, 0)]


def test_copy_parquet_report_with_an_empty_first_file(spark, monkeypatch):
    """The query equals its SQL where a writer's first task has no rows (F1)."""
    one_task = lambda s, d: clean(s, d).repartition(8, F.length("user_id") < 0)
    clean = catalog.cleaned
    monkeypatch.setattr(catalog, "cleaned", one_task)
    check(spark, catalog.QUERIES["copy_parquet_report"], catalog.ORACLE["copy_parquet_report"])


def test_a_script_that_fails_leaves_no_table(spark):
    args = {"first_day": None, "last_day": None, "target": "left_over"}
    spark.range(1).selectExpr("timestamp_ntz '2024-01-01' as event_time", "'view' as event_type").createOrReplaceTempView("script_events")
    import datetime as dt

    args |= {"first_day": dt.date(2024, 1, 1), "last_day": dt.date(2024, 1, 9)}
    bad = catalog.WEEKS_SCRIPT.replace("SET monday = date_add(monday, 7);", "SET monday = date_add(monday, 7); SELECT raise_error('broken');")
    assert run_block(spark, bad, args).count() == 0 and not spark.catalog.tableExists("left_over")
    assert [r.cnt for r in run_block(spark, catalog.WEEKS_SCRIPT, args).collect()] == [1] and spark.catalog.tableExists("left_over")
    spark.sql("drop table left_over")
    with pytest.raises(Exception):
        spark.table("left_over").count()
