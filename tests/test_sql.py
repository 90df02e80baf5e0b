from tidemark.plans.sql import run_script, statements


def test_statements_leave_strings_and_comments_alone():
    text = "select ';' as a; -- one; two\nselect `b;c` from t /* ; */;\n;  -- nothing\n"
    assert statements(text) == ["select ';' as a", "-- one; two\nselect `b;c` from t /* ; */"]


def test_parameters(spark):
    text = "create or replace temp view v as select * from range(10); select count(*) as n from v where id >= :low and id < :high"
    assert run_script(spark, text, {"low": 2, "high": 5}).first().n == 3
    assert run_script(spark, "") is None
