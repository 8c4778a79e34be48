"""Forests grown over binned rows: MLlib's trees, whatever the blocks, passes and pieces they are grown in."""

import numpy as np
import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.sql import functions as F

from segrules.operators import forest
from segrules.operators import importance as imp
from segrules.plans import pipelines
from segrules.plans.catalog import q_feature_importance


@pytest.fixture(scope="module")
def df(spark):
    h = lambda k, n: F.abs(F.xxhash64("id", F.lit(k))) % n
    rows = spark.range(3000).select(
        "id",
        (h(1, 200) / 7.0).alias("x"),  # more values than bins
        (h(2, 9) - 4).cast("double").alias("few"),
        F.lit(2.5).alias("one"),
        F.concat(F.lit("s"), F.sqrt(h(3, 64)).cast("int")).alias("s"),
        F.concat(F.lit("t"), h(4, 25)).alias("t"),
    )
    odd = (F.col("x") > 15) & F.col("s").isin("s1", "s4", "s7") | (F.col("few") * F.col("x") < -20) | (h(5, 10) == 0)
    return rows.withColumn("y", odd.cast("int")).drop("id").cache()


def grown(monkeypatch, df, **params):
    monkeypatch.setattr(imp, "LEAST_TREES", 1)
    monkeypatch.setattr(imp, "GROWN_COUNTS", 1)
    return imp.fit_forest(df, "y", **params)


def nodes(fitted):
    rows = [r.asDict() for r in imp.ensemble_nodes(fitted).drop("id").collect()]
    plain = lambda v: sorted(v) if isinstance(v, list) else round(v, 9) if isinstance(v, float) else v
    return {(r["tree"], r["node"]): {k: plain(v) for k, v in r.items()} for r in rows}


ONE = dict(num_trees=1, max_depth=6, max_bins=30, bootstrap=False, seed=1)


@pytest.mark.parametrize(
    "more", [{}, {"continuous": True}, {"impurity": "entropy"}, {"max_categories": 5, "max_bins": 60}, {"max_depth": 0}, {"all_categorical": True, "features": ["few", "s", "t"]}]
)
def test_a_tree_is_mllibs(df, monkeypatch, more):
    params = ONE | more
    plain = imp.fit_forest(df, "y", **params)
    got = grown(monkeypatch, df, **params)
    assert nodes(got) == nodes(plain)
    assert got.importances() == pytest.approx(plain.importances(), abs=1e-12)
    if params["max_depth"] and "continuous" not in more:
        assert any(n["left_categories"] for n in nodes(got).values())
    assert type(got.model) is type(plain.model) and got.model.getMaxDepth() == params["max_depth"]


def test_the_model_scores_rows_as_mllibs_does(df, monkeypatch):
    plain = imp.fit_forest(df, "y", **ONE, continuous=True)
    rows = plain.fm.data.select("features")
    before = plain.model.transform(rows).select("prediction", "probability").collect()
    assert grown(monkeypatch, df, **ONE, continuous=True).model.transform(rows).select("prediction", "probability").collect() == before


def test_blocks_passes_and_pieces_change_nothing(df, monkeypatch):
    whole = nodes(grown(monkeypatch, df, **ONE))
    for name, size in (("BLOCK_ROWS", 100), ("PASS_BYTES", 1), ("PIECE_CELLS", 16)):
        monkeypatch.setattr(forest, name, size)
    assert nodes(grown(monkeypatch, df, **ONE)) == whole


def test_a_forest_over_many_counts_is_not_left_to_mllib(df, monkeypatch):
    """MLlib's trainer, a microsecond a row, tree and level, sees the two rows that make an empty model only."""
    fit = RandomForestClassifier.fit
    seen = []
    monkeypatch.setattr(RandomForestClassifier, "fit", lambda self, data, *a: (seen.append(data.count()), fit(self, data, *a))[1])
    fitted = grown(monkeypatch, df, num_trees=12, max_depth=5, seed=3)
    assert seen == [2]
    assert fitted.model.getNumTrees == 12


def test_trees_differ_by_bootstrap_and_drawn_features(df, monkeypatch):
    params = dict(features=["x", "few", "s", "t"], num_trees=30, max_depth=4, max_bins=30, seed=3)
    plain = imp.fit_forest(df, "y", **params)
    fitted = grown(monkeypatch, df, **params)
    roots = [n for (_, node), n in nodes(fitted).items() if node == 1]
    assert len(roots) == 30 and len({n["count"] for n in roots}) > 20
    assert abs(np.mean([n["count"] for n in roots]) - 3000) < 6 * np.sqrt(3000 / 30)
    assert len({n["feature_name"] for n in roots}) >= 3
    assert fitted.importances() == pytest.approx(plain.importances(), abs=0.12)
    assert nodes(grown(monkeypatch, df, **params)) == nodes(fitted)  # the same seed, the same forest
    assert nodes(grown(monkeypatch, df, **params | {"seed": 4})) != nodes(fitted)


def test_importances_from_the_node_table(df, monkeypatch):
    fitted = grown(monkeypatch, df, num_trees=5, max_depth=5, max_bins=30, seed=2)
    found = {r["feature_name"]: r["importance"] for r in imp.ensemble_importance(imp.ensemble_nodes(fitted), fitted.fm).collect()}
    names = [fitted.fm.nominal.get(s, s) for s in fitted.fm.slots]
    assert [found[n] for n in names] == pytest.approx(fitted.importances(), abs=1e-9)


@pytest.mark.parametrize("rate", [1.0, 0.3])
def test_bootstrap_counts_are_poisson(rate):
    bag = forest.Bag(rate, True)
    n = 400_000
    counts = bag.counts([1, 2, 3, 4], n)
    assert len(counts) == n and (counts == bag.counts([1, 2, 3, 4], n)).all() and (counts != bag.counts([1, 3, 3, 4], n)).any()
    p = np.exp(-rate)
    for k in range(6):
        assert abs((counts == k).sum() - n * p) < 6 * np.sqrt(n * p) + 1
        p *= rate / (k + 1)


def test_a_share_of_the_rows_without_bootstrap():
    counts = forest.Bag(0.25, False).counts([5], 100_000)
    assert set(counts.tolist()) == {0, 1} and abs(counts.sum() - 25_000) < 6 * np.sqrt(100_000 * 0.25 * 0.75)
    assert (forest.Bag(1.0, False).counts([5], 9) == 1).all()


def test_three_classes_are_mllibs(spark, monkeypatch):
    rows = spark.createDataFrame([(float(i % 7), f"c{i % 3}") for i in range(60)], "x double, y string")
    assert grown(monkeypatch, rows, num_trees=2, max_depth=2, seed=1).model.numClasses == 3


def test_feature_importance_over_many_counts(spark, df, monkeypatch):
    """The query's own forest (200 trees, depth 10) in ten passes over the rows, with the planted features first."""
    monkeypatch.setattr("segrules.plans.catalog._fixture_cut", lambda *a: df.withColumnRenamed("y", "converted"))
    monkeypatch.setattr(imp, "GROWN_COUNTS", 1)
    passes = []
    level = forest._level_splits
    monkeypatch.setattr(forest, "_level_splits", lambda blocks, trees, *a: (passes.append(len(trees)), level(blocks, trees, *a))[1])
    rows = q_feature_importance(spark, "").collect()
    assert passes[0] == 200 and len(passes) == 10
    assert sum(r["importance"] for r in rows) == pytest.approx(1.0)
    assert rows[0]["feature_name"] == "x" and rows[-1] == ("one", 0.0)


def test_segment_report_over_many_counts(spark, df, monkeypatch):
    """All candidates are kept, so the tree's report is the same whoever grows the forest; MLlib's forest trainer gets no rows for it."""
    params = dict(path_column=None, reduce_caps={}, forest=pipelines.ForestParams(num_trees=12, max_depth=5, seed=7))
    before = pipelines.segment_report(df, "y", **params).collect()
    monkeypatch.setattr(imp, "GROWN_COUNTS", 1)
    fit, seen = RandomForestClassifier.fit, []
    monkeypatch.setattr(RandomForestClassifier, "fit", lambda self, data, *a: (seen.append(data.count()), fit(self, data, *a))[1])
    assert sorted(pipelines.segment_report(df, "y", **params).collect()) == sorted(before)
    assert seen == [2]
