"""Brute-force checks of path extraction and distributed ranking on random inputs."""

import random

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from segrules.operators.reduce import global_row_number
from segrules.operators.rules import leaf_conditions


def _random_tree(seed, max_depth):
    """Heap-numbered binary tree: {node: (feature, threshold)} for inner nodes, plus leaf ids."""
    rnd = random.Random(seed)
    inner, leaves, todo = {}, [], [1]
    while todo:
        n = todo.pop()
        depth = n.bit_length() - 1
        if depth < max_depth and (n == 1 or rnd.random() < 0.7):
            inner[n] = (f"f{rnd.randint(0, 3)}", float(rnd.randint(0, 5)))
            todo += [2 * n, 2 * n + 1]
        else:
            leaves.append(n)
    return inner, leaves


def _walk(inner, leaf, scope, merge):
    depth = leaf.bit_length() - 1
    start = 1 if scope == "parent" else 0
    conds = []
    for j in range(depth - 1, start - 1, -1):  # root first
        entered, parent = leaf >> j, leaf >> (j + 1)
        f, t = inner[parent]
        conds.append((depth - j, f, "<=" if entered % 2 == 0 else ">", t))
    if merge == "last":
        last = {}
        for c in conds:
            last[c[1]] = c
        conds = sorted(last.values())
    return conds


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(seed=st.integers(0, 10_000), max_depth=st.integers(1, 5))
def test_leaf_conditions_match_a_tree_walk(spark, seed, max_depth):
    inner, leaves = _random_tree(seed, max_depth)
    rows = [(n, n.bit_length() - 1, False, f, t) for n, (f, t) in inner.items()]
    rows += [(n, n.bit_length() - 1, True, None, None) for n in leaves]
    nodes = spark.createDataFrame(rows, "node int, depth int, is_leaf boolean, feature_name string, threshold double")
    for scope in ("full", "parent", "leaf"):
        for merge in ("all", "last"):
            got = {}
            for r in leaf_conditions(nodes, scope, merge).collect():
                got.setdefault(r["node"], []).append((r["level"], r["feature"], r["op"], r["threshold"]))
            want = {n: _walk(inner, n, scope, merge) for n in leaves}
            want = {n: c for n, c in want.items() if c}
            assert {n: sorted(c) for n, c in got.items()} == want, (scope, merge)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(values=st.lists(st.tuples(st.integers(0, 5), st.text(alphabet="abc", max_size=3)), min_size=1, max_size=60))
def test_global_row_number_matches_window(spark, values):
    rows = [(i, c, v) for i, (c, v) in enumerate(values)]
    df = spark.createDataFrame(rows, "id int, c int, v string").repartition(4)
    order = [F.desc("c"), F.asc("v"), F.asc("id")]
    got = sorted((r["id"], r["rank"]) for r in global_row_number(df, order, "rank").collect())
    want = sorted((r[0], r[1]) for r in df.select("id", F.row_number().over(Window.orderBy(*order))).collect())
    assert got == want
