"""Saved trees, exact importances, catalog scans and working sets."""

import os

import pytest
from pyspark.sql import functions as F

from segrules.operators import importance as imp
from segrules.operators.scorer import load_tree, save_tree, score_frame
from segrules.operators.tree import fit_segment_tree
from segrules.plans import pipelines
from segrules.plans.catalog import RESPONSE, TAGS, TREE_FEATURES
from segrules.session import WorkingSet, checkpoint_root, cut_lineage, shared_path
from segrules.sources.tables import funnel_fixture, read_table, save_table, scan_table, sql_rows
from segrules.streaming import score_stream

from conftest import SF_SMALL


@pytest.fixture(scope="module")
def fx(spark):
    return cut_lineage(funnel_fixture(spark, SF_SMALL).select(*TAGS, *TREE_FEATURES, "nation", RESPONSE))


@pytest.fixture(scope="module")
def saved(spark, fx):
    tree = fit_segment_tree(fx, RESPONSE, features=TREE_FEATURES, max_depth=4, keep=TAGS)
    path = shared_path(spark, "saved")
    save_tree(tree, path)
    save_tree(tree, path)  # replaced, not refused
    return tree, path


# -- importances ---------------------------------------------------------------


def test_importances_from_the_node_table_equal_the_models(spark, fx):
    fitted = imp.fit_forest(fx.drop(*TAGS), RESPONSE, num_trees=7, max_depth=5, seed=3)
    nodes = imp.ensemble_nodes(fitted)
    assert nodes.where("left_categories is not null").count() > 0 and nodes.where("threshold is not null").count() > 0
    assert nodes.groupBy("tree").count().count() == 7
    model = dict(zip([fitted.fm.nominal.get(s, s) for s in fitted.fm.slots], fitted.model.featureImportances.toArray()))
    got = {r["feature_name"]: r["importance"] for r in imp.ensemble_importance(nodes, fitted.fm).collect()}
    assert got.keys() == model.keys()
    assert all(got[k] == pytest.approx(model[k], abs=1e-9) for k in model)
    # heap ids: every inner node has both children, every other node a parent
    heap = {(r["tree"], r["node"]): r["is_leaf"] for r in nodes.collect()}
    assert all(((t, 2 * n) in heap and (t, 2 * n + 1) in heap) != leaf for (t, n), leaf in heap.items())


@pytest.mark.parametrize("continuous", [True, False])
def test_node_counts_recounted_from_rows(spark, fx, continuous):
    fitted = imp.fit_forest(fx.drop(*TAGS), RESPONSE, num_trees=1, max_depth=4, bootstrap=False, continuous=continuous, seed=1)
    nodes = imp.ensemble_nodes(fitted)
    counted = {r["node"]: r["rows"] for r in imp.recount_nodes(nodes, fitted.fm.data).collect()}
    assert counted == {r["node"]: r["count"] for r in nodes.collect()}


def test_a_constant_response_has_no_importance(spark):
    df = spark.createDataFrame([(float(i), "c", 1) for i in range(20)], "x double, s string, y int")
    fitted = imp.fit_forest(df, "y", num_trees=2, max_depth=2, seed=1)
    assert {tuple(r) for r in imp.ensemble_importance(imp.ensemble_nodes(fitted), fitted.fm).collect()} == {("x", 0.0, 0), ("s", 0.0, 0)}


def test_selection_changes_the_report(spark, fx):
    frame = fx.drop(*TAGS)
    args = dict(path_column=None, reduce_caps={}, forest=pipelines.EXACT_FOREST)
    two, three = (pipelines.segment_report(frame, RESPONSE, num_features=n, **args).collect() for n in (2, 3))
    assert {r["rules"] for r in two} != {r["rules"] for r in three}
    other = pipelines.segment_report(frame.withColumn("quantity", F.lit(1.0)), RESPONSE, num_features=2, **args).collect()
    assert any("QUANTITY" in r["rules"] for r in two) and not any("QUANTITY" in r["rules"] for r in other)


# -- saved trees ---------------------------------------------------------------


def test_a_loaded_tree_scores_as_the_fitted_one(spark, fx, saved):
    tree, path = saved
    other = spark.newSession()
    loaded = load_tree(other, path)
    scored = score_frame(loaded, other.read.parquet(*fx.inputFiles()).withColumn("node", F.lit("clash")).withColumn("__s0", F.lit(1)))
    assert "__s0" in scored.columns and dict(scored.dtypes)["node"] == "int"
    p = F.col("prediction")
    own = tree.model.transform(tree.data).select(
        *TAGS, (p > 0.5).cast("double").alias("prediction"), F.round(F.greatest(p, 1 - p), 9).alias("probability"),
        (p > 0.5).cast("int").cast("string").alias("predicted_label"),
    )
    assert sorted(map(tuple, scored.select(*TAGS, "prediction", F.round("probability", 9), "predicted_label").collect())) == sorted(map(tuple, own.collect()))
    with pytest.raises(ValueError):
        score_frame(loaded, fx.drop("quantity"))


def test_unseen_categories_by_policy(spark, fx, saved):
    loaded = load_tree(spark, saved[1])
    assert "priority" in loaded.nominal
    odd = fx.withColumn("priority", F.when(F.col("l_linenumber") == 1, F.lit("new")).when(F.col("l_linenumber") == 2, None).otherwise(F.col("priority")))
    known = fx.where("l_linenumber > 2").count()
    assert score_frame(loaded, odd, "skip").count() == known
    assert score_frame(loaded, odd, "keep").count() == fx.count()
    with pytest.raises(Exception, match="no index for a value of column priority"):
        score_frame(loaded, odd).collect()
    # a kept value fails every ``idx <= cut``: as the last label does
    labels = loaded.nominal["priority"]
    last = loaded.index.where(F.col("feature") == "priority").where(F.col("idx") == labels - 1).first()["value"]
    as_last = score_frame(loaded, fx.withColumn("priority", F.lit(last))).select(*TAGS, "node")
    kept = score_frame(loaded, fx.withColumn("priority", F.lit("new")), "keep").select(*TAGS, "node")
    assert kept.exceptAll(as_last).isEmpty()


def test_scores_on_a_stream(spark, fx, saved):
    loaded = load_tree(spark, saved[1])
    frame = fx.withColumn("priority", F.when(F.col("l_linenumber") == 7, F.lit("new")).otherwise(F.col("priority")))
    source, out = shared_path(spark, "stream-in"), shared_path(spark, "stream-out")
    frame.repartition(3).write.parquet(source)
    stream = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(source)
    query = score_stream(loaded, stream, out, shared_path(spark, "stream-state")).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    batch = score_frame(loaded, frame, "keep")
    streamed = spark.read.parquet(out).select(batch.columns)
    assert streamed.count() == frame.count() and streamed.exceptAll(batch).isEmpty()


# -- catalog scans ---------------------------------------------------------------


def test_catalog_scans_prune_and_push_down(spark):
    orders = read_table(spark, SF_SMALL, "orders")
    save_table(orders, "segrules_test_orders", ["o_orderpriority"], shared_path(spark, "orders"))
    try:
        text = "SELECT * FROM IDENTIFIER(:t) WHERE o_orderpriority = :p AND o_totalprice > :least"
        for df in (
            sql_rows(spark, text, t="segrules_test_orders", p="1-URGENT", least=1000.0).select("o_orderkey"),
            scan_table(spark, "segrules_test_orders", ["o_orderkey"], "o_orderpriority = :p AND o_totalprice > :least", p="1-URGENT", least=1000.0),
        ):
            scan = next(x for x in df._jdf.queryExecution().executedPlan().toString().splitlines() if "FileScan" in x)
            assert "PartitionFilters: [isnotnull(o_orderpriority" in scan and "= 1-URGENT)" in scan
            assert "GreaterThan(o_totalprice,1000.0)" in scan
            assert scan.split("ReadSchema: ")[1].startswith("struct<o_orderkey:bigint,o_totalprice:")
            want = orders.where("o_orderpriority = '1-URGENT' and o_totalprice > 1000").select("o_orderkey")
            assert df.exceptAll(want).isEmpty() and df.count() == want.count()
        assert sql_rows(spark, text, t="segrules_test_orders", p="x' OR '1'='1", least=0.0).count() == 0
        with pytest.raises(Exception, match="IDENTIFIER|identifier|PARSE|TABLE_OR_VIEW"):
            scan_table(spark, "segrules_test_orders; DROP TABLE segrules_test_orders").count()
        assert spark.catalog.tableExists("segrules_test_orders")
    finally:
        spark.sql("DROP TABLE segrules_test_orders")


# -- working sets ----------------------------------------------------------------


def _held(spark):
    folder = checkpoint_root(spark).removeprefix("file:")
    return sorted(os.listdir(folder)), spark.sparkContext._jsc.getPersistentRDDs().size(), len(spark.catalog.listDatabases())


def test_nothing_is_left_after_a_report(spark, fx):
    spark.catalog.clearCache()
    before = _held(spark)
    frame = fx.drop(*TAGS)
    args = dict(path_column=None, reduce_caps={"nation": 5}, num_features=3, forest=pipelines.ForestParams(num_trees=2, max_depth=3, seed=1))
    report = pipelines.segment_report(frame, RESPONSE, **args)
    importance = pipelines.importance_job(frame, TREE_FEATURES, RESPONSE, pipelines.ForestParams(num_trees=2, max_depth=3, seed=1))
    rules = pipelines.rules_job(frame, importance, 3, RESPONSE)
    assert _held(spark) == before
    assert report.count() > 3 and rules.count() > 3 and importance.count() == 5  # results stand by themselves


def test_working_sets_nest_and_survive_errors(spark):
    before = _held(spark)
    with WorkingSet(spark) as outer:
        cut = cut_lineage(spark.range(5))
        with WorkingSet(spark) as inner:
            assert inner.folder in shared_path(spark, "x")
            held = inner.persist(cut_lineage(spark.range(7)))
            assert held.count() == 7 and held.is_cached
            small, large = inner.keep(held), inner.keep_table(held)
        assert not held.is_cached and not os.path.exists(inner.folder.removeprefix("file:"))
        assert small.count() == large.count() == 7 and outer.folder in large.inputFiles()[0] and cut.count() == 5
        with pytest.raises(RuntimeError):
            with WorkingSet(spark):
                cut_lineage(spark.range(3))
                raise RuntimeError
    assert _held(spark) == before and small.count() == 7
