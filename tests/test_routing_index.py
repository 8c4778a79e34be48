"""Index by joins, used-cut intervals and routed coverage, against plain Python."""

import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from segrules.operators import features as feat
from segrules.operators.report import leaf_coverage, rule_report
from segrules.operators.routing import leaf_column, node_counts, rule_counts
from segrules.operators.rules import leaf_conditions, leaf_rules
from segrules.operators.tree import fit_segment_tree, score_rows


def random_tree(seed, depth, slots, top):
    rnd = random.Random(seed)
    rows, todo = [], [1]
    while todo:
        n = todo.pop()
        leaf = n.bit_length() - 1 == depth or (n > 1 and rnd.random() < 0.03)
        f = None if leaf else rnd.choice(slots)
        rows.append(Row(node=n, depth=n.bit_length() - 1, is_leaf=leaf, feature_name=f, threshold=None if leaf else rnd.randrange(top) + 0.5))
        todo += [] if leaf else [2 * n, 2 * n + 1]
    return rows


def walk(table, values):
    n = 1
    while not table[n]["is_leaf"]:
        v = values[table[n]["feature_name"]]
        n = 2 * n + (not (v is not None and v <= table[n]["threshold"]))
    return n


def test_a_thousand_leaves_in_one_pass(spark):
    """Many leaves, wide index slots: one count by leaf, prefix sums, cells for widened rules."""
    slots = ["a_index", "b.c_index", "x"]
    nodes = random_tree(4, 10, slots, 5000)
    assert sum(r["is_leaf"] for r in nodes) > 600
    table = {r["node"]: r for r in nodes}
    rnd = random.Random(5)
    rows = [tuple(None if rnd.random() < 0.01 else float(rnd.randrange(5000)) for _ in slots) for _ in range(4000)]
    data = spark.createDataFrame(rows, "`a_index` double, `b.c_index` double, x double")
    reached = [walk(table, dict(zip(slots, r))) for r in rows]
    assert [r[0] for r in data.select(leaf_column(nodes)).collect()] == reached
    want = {}
    for n in reached:
        while n:
            want[n] = want.get(n, 0) + 1
            n >>= 1
    assert {r["node"]: r["rows"] for r in node_counts(data, nodes).collect()} == want

    frame = spark.createDataFrame(nodes, "node int, depth int, is_leaf boolean, feature_name string, threshold double")
    conds = leaf_conditions(frame, "parent", "last").collect()
    got = {r["node"]: r["rows"] for r in rule_counts(data, conds).collect()}
    by_rule = {}
    for c in conds:
        by_rule.setdefault(c["node"], []).append(c)
    for node in random.Random(6).sample(sorted(by_rule), 60):
        meets = lambda v, c: (v is not None and v <= c["threshold"]) == (c["op"] == "<=")
        assert got.get(node, 0) == sum(all(meets(dict(zip(slots, r))[c["feature"]], c) for c in by_rule[node]) for r in rows)
    assert got[1] == len(rows)


def test_coverage_lists_no_values(spark, monkeypatch):
    df = spark.range(3000).select(
        F.concat(F.lit("v"), F.pmod(F.hash("id"), F.lit(900))).alias("wide"), F.pmod(F.hash("id", F.lit(1)), F.lit(20)).alias("x"),
    ).withColumn("y", (F.pmod(F.hash("wide"), F.lit(3)) > F.col("x") / 10).cast("int"))
    tree = fit_segment_tree(df, "y", max_depth=6)
    monkeypatch.setattr(feat, "interval_values", None)
    for merge in ("all", "last"):
        cov = leaf_coverage(tree, merge=merge)
        assert "collect_" not in cov._jdf.queryExecution().optimizedPlan().toString()
        total = {r["total"] for r in cov.collect()}
        assert total == {3000}
    assert sum(r["coverage"] for r in leaf_coverage(tree).collect()) == 3000


def test_interval_values_are_linear_and_exact(spark):
    index = spark.createDataFrame([("f", f"v{i}", float(i)) for i in range(50)] + [("g", "only", 0.0)], "feature string, value string, idx double")
    cuts = spark.createDataFrame([("f", 3.5), ("f", 20.5), ("f", 3.5), ("f", 48.5), ("other", 1.5)], "feature string, threshold double")
    lists = feat.interval_values(index, cuts, bucket=10).collect()
    assert sum(len(r["values"]) for r in lists) == 50 and max(len(r["values"]) for r in lists) <= 10
    for r in lists:
        for v in r["values"]:
            i = int(v[1:])
            assert r["interval"] == sum(t < i for t in (3.5, 20.5, 48.5)) and r["bucket"] == i // 10
    got = {(r["threshold"], r["op"]): r["value_list"] for r in feat.category_conditions(index, cuts).collect()}
    assert len(got) == 6
    for t in (3.5, 20.5, 48.5):
        assert got[t, "<="] == ",".join(f'"v{i}"' for i in range(50) if i <= t)
        assert got[t, ">"] == ",".join(f'"v{i}"' for i in range(50) if i > t)


def test_a_million_values_are_indexed_without_a_list_on_the_driver(spark, monkeypatch):
    df = spark.range(1_000_000).select(
        F.concat(F.lit("value "), F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id"))).alias("long.tail"),  # one value holds a third
        (F.col("id") % 7).cast("double").alias("x"), (F.col("id") % 7 > 3).cast("int").alias("y"),
    )
    brought, collect = [], type(df).collect

    def counted(self):
        rows = collect(self)
        brought.append(len(rows))
        return rows

    monkeypatch.setattr(type(df), "collect", counted)
    fm = feat.feature_matrix(df, "y")
    tree = fit_segment_tree(df, "y", max_depth=2, fm=fm)
    assert max(brought) < 300
    monkeypatch.undo()
    assert fm.label_counts == {"long.tail": 666_667}
    hot = fm.index.where("feature = 'long.tail' and idx = 0").first()
    assert (hot["value"], hot["count"]) == ("value 0", 333_334)
    assert fm.data.where("`long.tail` = 'value 0'").select(F.max(F.col("`long.tail_index`"))).first()[0] == 0.0
    assert fm.data.agg(F.countDistinct(F.col("`long.tail_index`")), F.max(F.col("`long.tail_index`"))).first() == (666_667, 666_666.0)
    first = tree.nodes.where("node = 1").first()
    assert (first["feature_name"], first["threshold"]) == ("x", 3.5)


@pytest.mark.parametrize("all_categorical", [False, True])
def test_dotted_names(spark, all_categorical):
    rows = [(f"c{i % 3}", float(i % 5), "yes" if i % 3 and i % 5 > 1 else "no", i) for i in range(200)]
    dotted = spark.createDataFrame(rows, "`a.b` string, `x y.z` double, `res.p` string, `row.id` int")
    plain = spark.createDataFrame(rows, "a string, x double, p string, i int")
    trees = [
        fit_segment_tree(dotted, "res.p", max_depth=3, keep=["row.id"], all_categorical=all_categorical),
        fit_segment_tree(plain, "p", max_depth=3, keep=["i"], all_categorical=all_categorical),
    ]
    shapes = [sorted((r["node"], r["count"], r["threshold"] or 0, r["predicted_label"]) for r in t.nodes.collect()) for t in trees]
    assert shapes[0] == shapes[1]
    scored = [score_rows(t, keep=[k]).collect() for t, k in zip(trees, ["row.id", "i"])]
    assert sorted(map(tuple, scored[0])) == sorted(map(tuple, scored[1]))
    texts = [sorted((r["node"], r["rules"], r["coverage"]) for r in rule_report(t, style="sql").collect()) for t in trees]
    rename = lambda s: s.replace("a.b", "a").replace("x y.z", "x")
    assert [(n, rename(s), c) for n, s, c in texts[0]] == texts[1]


def test_index_columns_policies(spark):
    index = spark.createDataFrame([("c", "a", 0.0), ("c", "b", 1.0)], "feature string, value string, idx double")
    df = spark.createDataFrame([(1, "a"), (2, "zz"), (3, None), (4, "b")], "id int, c string")
    keep = {r["id"]: r["c_index"] for r in feat.index_columns(df, index, ["c"], "keep", {"c": 2}).collect()}
    assert keep == {1: 0.0, 2: 2.0, 3: 2.0, 4: 1.0}
    assert {r["id"] for r in feat.index_columns(df, index, ["c"], "skip").collect()} == {1, 4}
    with pytest.raises(Exception, match="no index for a value of column c"):
        feat.index_columns(df, index, ["c"]).collect()
    with pytest.raises(ValueError, match="invalid"):
        feat.index_columns(df, index, ["c"], "drop")


def test_merged_rules_cover_what_their_text_says(spark):
    rows = [(f"c{(i * 7) % 5}", float((i * 13) % 40), float((i * 5) % 9), int((i * 7) % 5 > 1 and (i * 13) % 40 > 11 or (i * 5) % 9 > 6)) for i in range(500)]
    df = spark.createDataFrame(rows, "c string, x double, z double, y int")
    tree = fit_segment_tree(df, "y", max_depth=4)
    from segrules.operators.rules import rule_predicate

    for scope in ("full", "parent", "leaf"):
        got = {r["node"]: r["coverage"] for r in leaf_coverage(tree, scope=scope, merge="last").collect()}
        for r in leaf_rules(tree, scope, "last").collect():
            assert got[r["node"]] == tree.fm.data.where(rule_predicate(r["rule_list"])).count(), (scope, r["node"])
