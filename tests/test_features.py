import pytest
from pyspark.ml.feature import StringIndexer
from pyspark.sql import functions as F

from segrules.operators.features import (
    categorical_slots,
    category_conditions,
    category_index,
    feature_matrix,
    split_columns,
)
from segrules.plans.catalog import CATEGORICAL, RESPONSE, TREE_FEATURES
from segrules.sources.tables import funnel_fixture, project_columns, quote_name

from conftest import SF_SMALL


@pytest.fixture(scope="module")
def fx(spark):
    df = funnel_fixture(spark, SF_SMALL).cache()
    yield df
    df.unpersist()


def test_split_columns(fx):
    cats, nums = split_columns(fx.select(*TREE_FEATURES, RESPONSE), RESPONSE)
    assert cats == ["priority", "p_type", "segment"]
    assert nums == ["quantity", "discount"]


def test_category_index_equals_string_indexer(fx):
    model = StringIndexer(inputCols=CATEGORICAL, outputCols=[c + "_i" for c in CATEGORICAL]).fit(fx)
    idx = category_index(fx, CATEGORICAL).collect()
    for col, labels in zip(CATEGORICAL, model.labelsArray):
        got = [r["value"] for r in sorted((r for r in idx if r["feature"] == col), key=lambda r: r["idx"])]
        assert got == list(labels)


def test_feature_matrix_slots_numeric_first(fx):
    fm = feature_matrix(fx, RESPONSE, features=TREE_FEATURES)
    assert fm.slots == ["quantity", "discount", "priority_index", "p_type_index", "segment_index"]
    assert fm.nominal == {"priority_index": "priority", "p_type_index": "p_type", "segment_index": "segment"}
    assert fm.response_labels == ["0", "1"]


def test_all_categorical_indexes_numbers(fx):
    fm = feature_matrix(fx, RESPONSE, features=["quantity", "p_type"], all_categorical=True)
    assert fm.slots == ["quantity_index", "p_type_index"]
    assert all("." in r["value"] for r in fm.index.where("feature = 'quantity'").collect())


def test_categorical_slots_threshold(fx):
    fm = feature_matrix(fx, RESPONSE, features=TREE_FEATURES)
    got = {r["feature"]: (r["n_distinct"], r["is_categorical"]) for r in categorical_slots(fm, 10).collect()}
    for name, (n, flag) in got.items():
        assert flag == (n <= 10), name


def test_category_conditions_prefix_suffix(spark):
    lookup = spark.createDataFrame(
        [("f", "a", 0.0), ("f", "b", 1.0), ("f", "c", 2.0)], "feature string, value string, idx double"
    )
    got = {(r["op"], r["threshold"]): r["value_list"] for r in category_conditions(lookup).collect()}
    assert got == {
        ("<=", 0.5): '"a"', (">", 0.5): '"b","c"',
        ("<=", 1.5): '"a","b"', (">", 1.5): '"c"',
    }


def test_quoted_projection(spark):
    df = spark.createDataFrame([(1, 2)], "`a-b` int, `c d` int")
    assert project_columns(df, ["c d", "a-b"]).columns == ["c d", "a-b"]
    assert quote_name("x`y") == "`x``y`"


def test_mixed_type_columns_index_and_reduce(spark):
    from segrules.operators.reduce import reduce_topn_multi

    df = spark.createDataFrame([(1.5, "a"), (1.5, "b"), (2.0, "a"), (3.0, "a")], "q double, s string")
    idx = {(r["feature"], r["value"]): r["idx"] for r in category_index(df, ["q", "s"]).collect()}
    assert idx[("q", "1.5")] == 0.0 and idx[("s", "a")] == 0.0
    out = sorted(reduce_topn_multi(df, {"q": 1, "s": 1}).collect(), key=lambda r: (r["q"], r["s"]))
    assert [tuple(r) for r in out] == [("1.5", "Other"), ("1.5", "a"), ("Other", "a"), ("Other", "a")]
