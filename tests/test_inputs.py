"""Input faults: three classes, suffixes, kept features, numeric ties, repeatable splits, the shared folder."""

from types import SimpleNamespace

import pytest

from segrules.operators.features import feature_matrix
from segrules.operators.importance import random_forest_importance
from segrules.operators.reduce import reduce_topn, top_values
from segrules.operators.tree import fit_segment_tree
from segrules.plans.pipelines import ForestParams, importance_job, train_test_split
from segrules.session import checkpoint_root


def test_three_classes_raise(spark):
    df = spark.createDataFrame([(float(i), i % 3) for i in range(30)], "x double, y int")
    with pytest.raises(ValueError, match="two classes"):
        fit_segment_tree(df, "y")


def test_numeric_name_with_index_suffix_is_kept(spark):
    df = spark.createDataFrame([(float(i), "ab"[i % 2], i % 2) for i in range(40)], "visit_index double, kind string, y int")
    got = random_forest_importance(df, "y", num_trees=2, max_depth=2, seed=1).collect()
    assert {r["feature_name"] for r in got} == {"visit_index", "kind"}


def test_kept_feature_stays_a_feature(spark):
    df = spark.createDataFrame([(i, float(i), i % 2) for i in range(10)], "id int, x double, y int")
    fm = feature_matrix(df, "y", features=["x"], keep=["id", "x"])
    assert fm.slots == ["x"] and set(df.columns) <= set(fm.data.columns)


def test_numeric_ties_order_by_number(spark):
    df = spark.createDataFrame([(9,), (9,), (10,), (10,), (5,)], "v int")
    assert [r["value"] for r in top_values(df, {"v": 2}).orderBy("rank").collect()] == ["10", "9"]
    assert sorted(r["v"] for r in reduce_topn(df, "v", 1).collect()) == ["10", "10", "Other", "Other", "Other"]


def test_importance_job_passes_its_categories(spark):
    df = spark.createDataFrame([(i % 15, i % 2) for i in range(90)], "x int, y int")
    few = ForestParams(num_trees=2, max_depth=2, seed=1, max_categories=2)
    assert len(importance_job(df, ["x"], "y", few).collect()) == 1


def test_split_does_not_depend_on_layout(spark):
    df = spark.range(500).selectExpr("id", "if(id % 7 = 0, null, cast(id as string)) as s")
    first, second = train_test_split(df)
    again, _ = train_test_split(df.repartition(7))
    assert sorted(first.collect()) == sorted(again.collect())
    assert first.count() + second.count() == 500 and 240 < first.count() < 360
    assert first.intersect(second).count() == 0


def test_cluster_without_shared_folder_raises():
    context = SimpleNamespace(getCheckpointDir=lambda: None, master="spark://host:7077")
    session = SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: d), sparkContext=context)
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        checkpoint_root(session)
