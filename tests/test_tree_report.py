
import pytest
from pyspark.sql import functions as F

from segrules.operators.report import coverage_counts, rule_report
from segrules.operators.rules import leaf_rules, rule_predicate
from segrules.operators.tree import fit_segment_tree, leaf_stats, score_rows
from segrules.plans.catalog import RESPONSE, TAGS, TREE_FEATURES
from segrules.session import cut_lineage
from segrules.sources.tables import funnel_fixture

from conftest import SF_ORACLE, SF_SMALL


@pytest.fixture(scope="module")
def fx(spark):
    return cut_lineage(funnel_fixture(spark, SF_SMALL))


@pytest.fixture(scope="module")
def tree(fx):
    return fit_segment_tree(fx, RESPONSE, features=TREE_FEATURES, max_depth=5, keep=TAGS)


def test_fixture_counts(spark):
    for sf, rows, pos in [(SF_SMALL, 6000, 1584), (SF_ORACLE, 60000, 14753)]:
        fx = funnel_fixture(spark, sf)
        assert fx.count() == rows
        assert fx.where(F.col("converted") == 1).count() == pos


def test_node_table_shape(tree):
    nodes = tree.nodes.collect()
    ids = {r["node"] for r in nodes}
    for r in nodes:
        assert r["probability"] >= 0.5
        assert r["impurity"] == pytest.approx(2 * r["p"] * (1 - r["p"]))
        if r["node"] > 1:
            assert r["node"] // 2 in ids
        if not r["is_leaf"]:
            assert {2 * r["node"], 2 * r["node"] + 1} <= ids
    assert max(r["depth"] for r in nodes) <= 5


def test_full_rules_partition_rows(tree, fx):
    rep = rule_report(tree).collect()
    total = fx.count()
    assert sum(r["coverage"] for r in rep) == total
    assert all(0 <= r["frequency"] <= 100 and 0 <= r["frequency_pct"] <= 100 for r in rep)
    leaf_counts = {r["node"]: r["count"] for r in tree.leaves.collect()}
    assert {r["node"]: r["coverage"] for r in rep} == leaf_counts


def test_each_row_in_one_leaf(tree):
    rules = leaf_rules(tree).collect()
    hits = sum(F.when(rule_predicate(r["rule_list"]), 1).otherwise(0) for r in rules)
    assert tree.fm.data.where(hits != 1).count() == 0


def test_parent_scope_covers_more(tree):
    full = {r["node"]: r["coverage"] for r in rule_report(tree, scope="full").collect()}
    parent = {r["node"]: r["coverage"] for r in rule_report(tree, scope="parent", merge="all").collect()}
    assert parent and all(parent[n] >= full[n] for n in parent)


def test_leaf_stats_match_model(tree):
    stats = {r["node"]: r for r in leaf_stats(tree).collect()}
    for leaf in tree.leaves.collect():
        s = stats[leaf["node"]]
        assert s["coverage"] == leaf["count"]
        assert s["probability"] == pytest.approx(leaf["probability"])


def test_scores_equal_leaf_statistics(tree):
    scored = score_rows(tree, keep=TAGS)
    by_leaf = scored.groupBy("leaf_index").agg(F.countDistinct("probability").alias("k"))
    assert by_leaf.where("k != 1").count() == 0


def test_single_leaf_tree_gives_empty_report(fx):
    single = fit_segment_tree(fx.where("converted = 1"), RESPONSE, features=TREE_FEATURES, max_depth=3)
    assert single.leaves.count() == 1
    rep = rule_report(single)
    assert rep.count() == 0
    assert [f.name for f in rep.schema.fields] == ["node", "prediction", "probability", "rules", "coverage", "frequency", "frequency_pct"]


def test_min_leaves(fx):
    stump = fit_segment_tree(fx, RESPONSE, features=TREE_FEATURES, max_depth=1)
    assert rule_report(stump, min_leaves=4).count() == 0
    assert rule_report(stump, min_leaves=2).count() == 2


def test_coverage_is_one_aggregation(tree):
    rules = leaf_rules(tree).collect()
    cov = coverage_counts(tree.fm.data, [(r["node"], rule_predicate(r["rule_list"])) for r in rules])
    plan = cov._jdf.queryExecution().executedPlan().toString()
    assert plan.count("HashAggregate") <= 2  # partial + final, one pass


def test_select_features_gives_the_same_tree(fx):
    from segrules.operators.features import feature_matrix, select_features

    subset = ["priority", "quantity", "p_type", "discount"]
    full = feature_matrix(fx, RESPONSE, features=[*TREE_FEATURES, "nation"])
    view = select_features(full, subset)
    fresh = feature_matrix(fx, RESPONSE, features=subset)
    assert view.slots == fresh.slots and view.label_counts == fresh.label_counts and view.nominal == fresh.nominal
    a = fit_segment_tree(fx, RESPONSE, max_depth=4, fm=view).nodes
    b = fit_segment_tree(fx, RESPONSE, features=subset, max_depth=4).nodes
    cols = ["node", "count", "feature_name", "threshold"]
    assert sorted(a.select(cols).collect()) == sorted(b.select(cols).collect())


def test_where_text_reproduces_coverage(tree):
    from segrules.operators.rules import rule_text

    texts = {r["node"]: r["w"] for r in leaf_rules(tree).select("node", rule_text("rule_list", "where").alias("w")).collect()}
    cover = {r["node"]: r["coverage"] for r in rule_report(tree).collect()}
    for node, text in texts.items():
        assert tree.fm.data.where(text).count() == cover[node], (node, text)
