"""The linear trailing-pair extraction equals the reference pattern's regexp_extract."""

import random

import pytest
from pyspark.sql import functions as F

from segrules.functions import paths

ALPHABET = list("ab Z9_|||-./?&#+<>=$^~()[]{}\"'`,;:!*%@\\") + [
    "\t", "\n", "\r", "\x0b", "\x0c", "\x00", "é", "€", "ß", " ", "\u0085", " ", " ",
    "\U0001F600", "。",
]


def _random_strings(n, seed):
    rnd = random.Random(seed)
    out = ["", "|", "||", "a|", "|a", "a|b|c|d", "é|b", "+1|Foo Bar", "a$b", "ab ", "ab|\r\n", "x|y|\n",
           "a  ", "a|b\u0085", "| "]
    for _ in range(n):
        out.append("".join(rnd.choice(ALPHABET) for _ in range(rnd.randint(1, 14))))
    return out


@pytest.mark.parametrize("fn,pattern", [
    (paths.last_pipe_pair, paths.LAST_PIPE_PAIR),
    (paths.page_name_tail, paths.PAGE_NAME_TAIL),
])
def test_linear_form_equals_pattern_random(spark, fn, pattern):
    df = spark.createDataFrame([(s,) for s in _random_strings(20000, 11)], "s string")
    diff = df.where(~fn("s").eqNullSafe(F.regexp_extract("s", pattern, 1)))
    assert diff.count() == 0, diff.limit(5).collect()


@pytest.mark.parametrize("fn,pattern", [
    (paths.last_pipe_pair, paths.LAST_PIPE_PAIR),
    (paths.page_name_tail, paths.PAGE_NAME_TAIL),
])
def test_linear_form_equals_pattern_on_tables(spark, fn, pattern):
    from segrules.sources.tables import funnel_fixture, read_table

    fx = funnel_fixture(spark, "/root/testdata/sf0.01")
    pages = read_table(spark, "/root/testdata/sf0.01", "pages", ["url"])
    values = (
        fx.select(F.col("first_page").alias("s"))
        .union(fx.select(paths.normalize_separators(paths.first_path_step("path")).alias("s")))
        .union(pages.select(paths.normalize_separators(paths.first_path_step("url")).alias("s")))
        .distinct()
    )
    assert values.where(~fn("s").eqNullSafe(F.regexp_extract("s", pattern, 1))).count() == 0


def test_null_in_null_out(spark):
    df = spark.createDataFrame([(None,)], "s string")
    assert df.select(paths.last_pipe_pair("s").alias("o")).first()["o"] is None


def test_long_strings_stay_linear(spark):
    import time

    long = "ab cd " * 5000 + "€"  # 30k characters, no match: worst case for the searched pattern
    ok = "ab cd " * 5000 + "x|y"
    df = spark.createDataFrame([(long,), (ok,)] * 8, "s string")
    t0 = time.perf_counter()
    out = [r["o"] for r in df.select(paths.clean_path("s").alias("o")).collect()]
    assert time.perf_counter() - t0 < 30
    assert out[0] == "" and out[1].endswith("x|y") and len(out[1]) > 29000
