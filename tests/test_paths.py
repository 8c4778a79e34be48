import pytest
from pyspark.sql import functions as F

from segrules.functions import paths

# Cases from the cleaning rules (FIXTURES.md section 3).
CASES = [
    (paths.first_path_step, "->a/b->c", "a/b"),
    (paths.first_path_step, "", ""),
    (paths.first_path_step, "->", ""),
    (paths.first_path_step, "x->y", "x"),
    (paths.normalize_separators, "a//b/c", "a|b|c"),
    (paths.normalize_separators, "a| |b", "a|b"),
    (paths.normalize_separators, "a||b", "a|b"),
    (paths.last_pipe_pair, "a|b|c|d", "c|d"),
    (paths.last_pipe_pair, "é|b", "|b"),
    (paths.last_pipe_pair, "+1|Foo Bar", "+1|Foo Bar"),
    (paths.last_pipe_pair, "a$b", "b"),
    (paths.strip_leading_non_letters, "+1|Foo Bar", "Foo Bar"),
    (paths.strip_leading_non_letters, "123", ""),
    (paths.page_name_tail, "a|b|c", "b|c"),
]


@pytest.mark.parametrize("fn,value,expected", CASES)
def test_string_cases(spark, fn, value, expected):
    df = spark.createDataFrame([(value,)], "s string")
    assert df.select(fn("s").alias("o")).first()["o"] == expected


def test_null_stays_null(spark):
    df = spark.createDataFrame([(None,)], "s string")
    row = df.select(paths.first_path_step("s").alias("a"), paths.clean_path("s").alias("b")).first()
    assert row["a"] is None and row["b"] is None


def test_clean_path_chain(spark):
    df = spark.createDataFrame([("->Shop//Phones/Deals->Cart",), ("",), ("->+1//Foo Bar",)], "s string")
    out = [r["o"] for r in df.select(paths.clean_path("s").alias("o")).collect()]
    assert out == ["Phones|Deals", "", "Foo Bar"]


def test_try_cast_null_on_bad_value(spark):
    df = spark.createDataFrame([("1.5",), ("x",)], "s string")
    assert [r["d"] for r in df.select(paths.to_double("s").alias("d")).collect()] == [1.5, None]


def test_no_python_udf_in_plan(spark):
    df = spark.createDataFrame([("->a//b->c",)], "s string").select(paths.clean_path("s").alias("o"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan
