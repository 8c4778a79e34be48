"""Rule building on the sample node dump kept in the reference's comments."""

import pytest
from pyspark.sql import functions as F

from segrules.operators.rules import flip, leaf_conditions, rule_predicate, rule_text

# The sample dump (node, prediction, probability, impurity, split feature, threshold).
SAMPLE = [
    (1, 0.0, 0.7633333333333333, 0.36131111111111114, "feature 2", 0.0),
    (2, 0.0, 0.5704225352112676, 0.4900813330688355, "feature 3", 8.0),
    (4, 0.0, 0.5954198473282443, 0.4817901054717091, "feature 5", 0.0),
    (8, 0.0, 0.6626506024096386, 0.4470895630715633, "feature 3", 4.0),
    (16, 0.0, 0.6231884057971014, 0.4696492333543374, "feature 3", 0.0),
    (32, 0.0, 0.76, 0.3648, None, None),
    (33, 0.0, 0.5454545454545454, 0.49586776859504145, None, None),
    (17, 0.0, 0.8571428571428571, 0.24489795918367355, "feature 0", 5.0),
]


@pytest.fixture(scope="module")
def nodes(spark):
    rows = [
        (n, n.bit_length() - 1, f is None, f, t)
        for n, _, _, _, f, t in SAMPLE
    ]
    return spark.createDataFrame(rows, "node int, depth int, is_leaf boolean, feature_name string, threshold double")


def paths(df):
    out = {}
    for r in df.orderBy("node", "level").collect():
        out.setdefault(r["node"], []).append(f"{r['feature']} {r['op']} {r['threshold']:g}")
    return out


def test_gini_identity_on_sample():
    for _, _, prob, impurity, _, _ in SAMPLE:
        assert impurity == pytest.approx(2 * prob * (1 - prob), abs=1e-12)


def test_gain_identity():
    # prob .75, impurity .375, left .5, right 0, gain .125 (sample comment)
    assert 2 * 0.75 * 0.25 == pytest.approx(0.375)
    assert 0.375 - 0.5 * 0.5 - 0.5 * 0.0 == pytest.approx(0.125)


def test_full_scope_paths(nodes):
    p = paths(leaf_conditions(nodes, "full", "all"))
    assert p[32] == ["feature 2 <= 0", "feature 3 <= 8", "feature 5 <= 0", "feature 3 <= 4", "feature 3 <= 0"]
    assert p[33] == ["feature 2 <= 0", "feature 3 <= 8", "feature 5 <= 0", "feature 3 <= 4", "feature 3 > 0"]


def test_parent_scope_last_condition(nodes):
    p = paths(leaf_conditions(nodes, "parent", "last"))
    assert p[32] == ["feature 2 <= 0", "feature 5 <= 0", "feature 3 <= 4"]
    assert p[33] == p[32]


def test_leaf_scope_last_condition(nodes):
    p = paths(leaf_conditions(nodes, "leaf", "last"))
    assert p[32] == ["feature 2 <= 0", "feature 5 <= 0", "feature 3 <= 0"]
    assert p[33] == ["feature 2 <= 0", "feature 5 <= 0", "feature 3 > 0"]


def test_flip(spark):
    df = spark.createDataFrame([(" <= ",), (">",)], "op string")
    assert [r[0] for r in df.select(flip(F.col("op"))).collect()] == [">", "<="]


RULE = [
    {"level": 1, "feature": "quantity", "column": "quantity", "op": "<=", "threshold": 30.5, "nominal": False, "values": []},
    {"level": 2, "feature": "custcbcatname_index", "column": "custcbcatname", "op": ">", "threshold": 0.5,
     "nominal": True, "values": ["Upgrade_Orders/Others", "Troubleshoot/Others", "Bill/Others"]},
]
RULE_SCHEMA = (
    "rule_list array<struct<level:int,feature:string,column:string,op:string,threshold:double,"
    "nominal:boolean,values:array<string>>>"
)


def test_rule_text_styles(spark):
    df = spark.createDataFrame([(RULE,)], RULE_SCHEMA)
    got = df.select(
        rule_text("rule_list", "print").alias("p"),
        rule_text("rule_list", "sql").alias("s"),
        rule_text("rule_list", "html", {"custcbcatname": "category"}).alias("h"),
    ).first()
    assert got["p"] == 'CUSTCBCATNAME : ["Upgrade_Orders/Others","Troubleshoot/Others","Bill/Others"]  &&  QUANTITY <= 30.5'
    assert got["s"] == "(quantity <= 30.5) and (custcbcatname in (Upgrade_Orders/Others,Troubleshoot/Others,Bill/Others))"
    assert got["h"] == "(quantity <= 30.5) <br> (category in (Upgrade_Orders/Others,Troubleshoot/Others,Bill/Others))"


def test_empty_value_list_matches_nothing(spark):
    df = spark.createDataFrame([("",), ("x",)], "c string")
    cond = [{"column": "c", "nominal": True, "values": [], "op": "<=", "threshold": 0.5}]
    assert df.where(rule_predicate(cond)).count() == 0
    assert df.where(rule_predicate([])).count() == 2


def test_values_with_quotes_and_in_are_literals(spark):
    df = spark.createDataFrame([('say "hi" in here',), ("a -> b",), ("z",)], "c string")
    cond = [{"column": "c", "nominal": True, "values": ['say "hi" in here', "a -> b"], "op": "<=", "threshold": 1.5}]
    assert df.where(rule_predicate(cond)).count() == 2


def test_where_text_filters_like_the_predicate(spark):
    df = spark.createDataFrame(
        [("Upgrade_Orders/Others", 10.0), ("it's \\\\ odd", 40.0), ("Bill/Others", 31.0), ("x", 1.0)],
        "custcbcatname string, quantity double",
    )
    rule = [
        {**RULE[0], "op": ">", "threshold": 5.0},
        {**RULE[1], "values": ["Upgrade_Orders/Others", "it's \\\\ odd", "Bill/Others"]},
    ]
    rows = spark.createDataFrame([(rule,)], RULE_SCHEMA)
    text = rows.select(rule_text("rule_list", "where").alias("w")).first()["w"]
    assert df.where(text).count() == df.where(rule_predicate(rule)).count() == 3
    empty = [{**RULE[1], "values": []}]
    text = spark.createDataFrame([(empty,)], RULE_SCHEMA).select(rule_text("rule_list", "where").alias("w")).first()["w"]
    assert text == "false" and df.where(text).count() == 0
