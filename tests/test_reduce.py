import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from segrules.operators.reduce import reduce_topn, reduce_topn_multi, top_values, value_counts_window, value_rank

# a x3, b x3, blank x2, null x4, c x1, a literal Other x1 (FIXTURES.md section 4)
VALUES = ["a"] * 3 + ["b"] * 3 + [""] * 2 + [None] * 4 + ["c"] + ["Other"]


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame([(i, v) for i, v in enumerate(VALUES)], "id int, v string")


def window_form(df, col, n):
    """The global-window formulation, used as brute force."""
    ranked = df.withColumn("cnt", F.count(col).over(Window.partitionBy(col))).withColumn(
        "rk", F.dense_rank().over(Window.orderBy(F.desc("cnt"), F.desc(col)))
    )
    return ranked.select(
        "id",
        F.when(F.col("rk") > n, "Other").when(F.col(col) == "", "Unknown").otherwise(F.col(col)).alias(col),
    )


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 6, 7])
def test_topn_equals_window_form(spark, frame, n):
    got = sorted(reduce_topn(frame, "v", n).collect(), key=lambda r: r["id"])
    want = sorted(window_form(frame, "v", n).collect(), key=lambda r: r["id"])
    assert got == want


def test_documented_cases(spark, frame):
    def labels(n):
        return {r["id"]: r["v"] for r in reduce_topn(frame, "v", n).collect()}

    assert set(labels(2).values()) == {"a", "b", "Other"}
    assert "Unknown" in labels(3).values()
    assert labels(5)[8] == "Other"  # null out of the top 5
    assert labels(6)[8] is None  # null inside the top 6 stays null


def test_multi_equals_sequential(spark):
    fx = spark.read.parquet("/root/testdata/sf0.001/part.parquet").select("p_partkey", "p_type", "p_brand")
    seq = reduce_topn(reduce_topn(fx, "p_type", 3), "p_brand", 5)
    multi = reduce_topn_multi(fx, {"p_type": 3, "p_brand": 5})
    assert sorted(seq.collect()) == sorted(multi.collect())


def test_topn_plan_has_partial_group_limit(spark, frame):
    plan = top_values(frame, {"v": 2})._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_value_rank_matches_row_number(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/part.parquet").select("p_brand")
    got = sorted((r["value"], r["count"], r["rank"]) for r in value_rank(df, "p_brand").collect())
    counts = df.groupBy("p_brand").agg(F.count("p_brand").alias("c"))
    w = Window.orderBy(F.desc("c"), F.desc_nulls_last("p_brand"))
    want = sorted((r[0], r[1], r[2]) for r in counts.select("p_brand", "c", F.row_number().over(w)).collect())
    assert got == want


def test_value_counts_window_matches_window(spark, frame):
    got = sorted((r["id"], r["count"]) for r in value_counts_window(frame, "v", keep=["id"]).collect())
    want = sorted((r[0], r[1]) for r in frame.select("id", F.count("v").over(Window.partitionBy("v"))).collect())
    assert got == want
