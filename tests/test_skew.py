"""A value holding a third of all rows: results stay whole and the hot key is split."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from segrules.operators.reduce import reduce_topn, top_values, value_counts_window


def _hot_frame(spark, n=30000):
    return spark.range(n).select(
        F.col("id"),
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("v"), (F.col("id") % 997).cast("string"))).alias("v"),
    ).repartition(16)


def test_hot_key_join_is_split_and_whole(spark):
    conf = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    old = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        df = _hot_frame(spark)
        out = value_counts_window(df, "v", keep=["id"])
        rows = out.collect()
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "isFinalPlan=true" in plan
        assert "skew=true" in plan
        assert len(rows) == 30000
        assert {r["count"] for r in rows if r["value"] == "hot"} == {10000}
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def test_hot_value_topn_whole(spark):
    df = _hot_frame(spark)
    out = reduce_topn(df, "v", 3)
    assert out.count() == 30000
    assert out.where("v = 'hot'").count() == 10000
    top = [r["value"] for r in top_values(df, {"v": 3}).orderBy("rank").collect()]
    assert top[0] == "hot"


def _window_form(df, n):
    ranked = df.withColumn("cnt", F.count("v").over(Window.partitionBy("v"))).withColumn(
        "rk", F.dense_rank().over(Window.orderBy(F.desc("cnt"), F.desc("v")))
    )
    return ranked.select("id", F.when(F.col("rk") > n, "Other").when(F.col("v") == "", "Unknown").otherwise(F.col("v")).alias("v"))


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    values=st.lists(st.sampled_from(["a", "b", "c", "", None, "Other", "Unknown", "d e"]), min_size=1, max_size=30),
    n=st.integers(min_value=1, max_value=9),
)
def test_topn_property(spark, values, n):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id int, v string")
    got = sorted(reduce_topn(df, "v", n).collect(), key=lambda r: r["id"])
    want = sorted(_window_form(df, n).collect(), key=lambda r: r["id"])
    assert got == want
