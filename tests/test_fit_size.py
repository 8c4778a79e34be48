"""Fits on many rows: rows of a task bounded whatever they compress to, forests grown in groups of trees."""

import pytest
from pyspark.sql import functions as F

from segrules.operators import features as feat
from segrules.operators import importance as imp
from segrules.operators.tree import fit_segment_tree


@pytest.fixture(scope="module")
def df(spark):
    rows = spark.range(4000).coalesce(1)
    return rows.select(
        (F.col("id") % 10).cast("double").alias("x"),
        F.concat(F.lit("s"), F.col("id") % 3).alias("s"),
        ((F.col("id") % 10 > 6) | (F.col("id") % 30 == 2)).cast("int").alias("y"),
    )


def test_rows_are_counted_by_the_index(df):
    assert feat.feature_matrix(df, "y").rows == 4000


def test_a_fit_on_many_rows_reads_bounded_files(spark, df, monkeypatch):
    monkeypatch.setattr(feat, "FIT_IN_MEMORY", 1000)
    monkeypatch.setattr(feat, "FIT_FILE_ROWS", 500)
    fm = feat.feature_matrix(df, "y")
    train = fm.data.select(F.col("y_index").alias("label"), feat.plain_vector(fm.slots).alias("v"))
    with feat.fit_input(train, fm.rows) as points:
        assert points.count() == 4000
        assert max(r["count"] for r in points.groupBy(F.input_file_name()).count().collect()) <= 500
        assert points.rdd.getNumPartitions() >= min(8, spark.sparkContext.defaultParallelism)
        assert sorted(map(str, points.collect())) == sorted(map(str, train.collect()))


def test_the_tree_is_the_same_on_many_rows(spark, df, monkeypatch):
    few = fit_segment_tree(df, "y", max_depth=3).nodes.collect()
    monkeypatch.setattr(feat, "FIT_IN_MEMORY", 1000)
    monkeypatch.setattr(feat, "FIT_FILE_ROWS", 500)
    assert sorted(fit_segment_tree(df, "y", max_depth=3).nodes.collect()) == sorted(few)


def test_groups_hold_all_trees():
    assert imp.tree_groups(600_000, 200) == [200] and imp.tree_groups(0, 200) == [200] and imp.tree_groups(10**9, 1) == [1]
    assert imp.tree_groups(36_000_000, 200) == [10] * 20
    for rows in (1_500_000, 7_000_000, 300_000_000):
        sizes = imp.tree_groups(rows, 200)
        assert sum(sizes) == 200 and max(sizes) * rows <= max(imp.BAG_COUNTS, imp.LEAST_TREES * rows) and max(sizes) - min(sizes) <= 1


def test_a_forest_in_groups_is_one_forest(spark, df, monkeypatch):
    monkeypatch.setattr(imp, "BAG_COUNTS", 8000)
    monkeypatch.setattr(imp, "LEAST_TREES", 1)
    monkeypatch.setattr(imp, "NODE_IDS", 1)
    fitted = imp.fit_forest(df, "y", num_trees=5, max_depth=3, seed=3)
    assert [m.getNumTrees for m in fitted.models] == [2, 2, 1]
    nodes = imp.ensemble_nodes(fitted)
    assert {r["tree"] for r in nodes.select("tree").distinct().collect()} == set(range(5))
    # groups draw other bootstrap samples: the roots' class counts differ from tree to tree
    assert len({(r["count"], r["impurity"]) for r in nodes.where("node = 1").collect()}) >= 4
    got = {r["feature_name"]: r["importance"] for r in imp.ensemble_importance(nodes, fitted.fm).collect()}
    names = [fitted.fm.nominal.get(s, s) for s in fitted.fm.slots]
    assert [got[n] for n in names] == pytest.approx(fitted.importances(), abs=1e-9)
    # a group of one tree still draws its features at random, as the forest does
    assert fitted.models[-1].getFeatureSubsetStrategy() == "sqrt"


def test_a_forest_on_many_rows_keeps_no_node_ids(spark, df, monkeypatch):
    assert imp.fit_forest(df, "y", num_trees=2, max_depth=2, seed=3).model.getCacheNodeIds()
    monkeypatch.setattr(feat, "FIT_IN_MEMORY", 1000)
    monkeypatch.setattr(imp, "FIT_IN_MEMORY", 1000)
    fitted = imp.fit_forest(df, "y", num_trees=2, max_depth=2, seed=3)
    assert not fitted.model.getCacheNodeIds()
    assert sum(fitted.importances()) == pytest.approx(1.0)


def test_a_task_of_a_fit_gets_a_million_rows_at_most():
    # 32 files of Spark's default sizes
    assert 32 * feat.FIT_FILE_ROWS <= 1 << 20
