import pytest
from pyspark.sql import functions as F

from segrules.plans import pipelines
from segrules.plans.catalog import RESPONSE, TAGS, TREE_FEATURES
from segrules.sources.tables import funnel_fixture

from conftest import SF_SMALL


@pytest.fixture(scope="module")
def funnel(spark):
    return (
        funnel_fixture(spark, SF_SMALL)
        .withColumnRenamed("first_page", "first_hit_pagename")
        .withColumnRenamed("path", "post_prop11_concat")
    )


def test_segment_report_end_to_end(funnel):
    rep = pipelines.segment_report(
        funnel, RESPONSE, forest=pipelines.ForestParams(num_trees=10, max_depth=4, seed=3), exclude=TAGS
    ).collect()
    assert rep
    assert sum(r["coverage"] for r in rep) == funnel.count()
    assert all(r["probability"] >= 0.5 for r in rep)
    assert all(r["rules"] for r in rep)


def test_prepare_caps_categories(funnel):
    out = pipelines.prepare(funnel, "post_prop11_concat", pipelines.DEFAULT_REDUCE_CAPS)
    assert out.select("first_hit_pagename").distinct().count() <= 16
    assert out.select("post_prop11_concat").distinct().count() <= 26
    assert out.where(F.col("post_prop11_concat").contains("->")).count() == 0


def test_rules_job_all_categorical(funnel):
    fx = funnel.select(*TREE_FEATURES, RESPONSE)
    imp = pipelines.importance_job(fx, TREE_FEATURES, RESPONSE, pipelines.ForestParams(num_trees=5, max_depth=3, seed=1))
    rep = pipelines.rules_job(fx, imp, 3, RESPONSE).collect()
    for r in rep:
        assert '"' not in r["rules"] and "`" not in r["rules"]
        assert " in (" in r["rules"]
        assert 0 < r["frequency"] <= 100


def test_train_test_split_is_whole(funnel):
    train, test = pipelines.train_test_split(funnel, (0.6, 0.4), 11)
    assert train.count() + test.count() == funnel.count()


def test_older_jobs_with_awkward_names_and_leaf_guard(funnel):
    from segrules.operators.report import REPORT_SCHEMA

    fx = funnel.select("priority", F.col("p_type").alias("p-type"), F.col("segment").alias("seg ment"), RESPONSE)
    imp = pipelines.importance_job(fx, ["priority", "p-type", "seg ment"], RESPONSE,
                                   pipelines.ForestParams(num_trees=5, max_depth=3, seed=1))
    assert sorted(r["feature_name"] for r in imp.collect()) == ["p-type", "priority", "seg ment"]
    guarded = pipelines.rules_job(fx, imp, 3, RESPONSE, tree=pipelines.TreeParams(max_depth=1))
    assert guarded.count() == 0 and guarded.schema == REPORT_SCHEMA
    rep = pipelines.rules_job(fx, imp, 3, RESPONSE, tree=pipelines.TreeParams(max_depth=3)).collect()
    assert rep and all(r["coverage"] > 0 for r in rep)
