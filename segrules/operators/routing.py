"""Routing rows down a tree: a leaf per row, coverage of nodes and of rules.

A node table (heap ids, ``feature_name``, ``threshold``) becomes one CASE expression, of which a row evaluates the
comparisons on its own path.  Rows are counted once, by leaf; the counts of all other nodes, and so
of every rule that is a whole path or ends above the leaf, are sums over heap-id prefixes.  Rules that
dropped conditions on their way are counted on cells instead: rows with the same place among the used cuts
of every feature are one cell, and rules are held against cells.  Conditions on categories compare
indexes, so no list of values is needed, and no predicate grows with the number of categories.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from segrules.sources.tables import quote_name


def node_expression(nodes: Sequence[Row], leaf_value) -> str:
    """SQL of ``leaf_value(row)`` of the leaf that a row of slot columns reaches.

    A null or NaN in a slot fails ``<=`` and goes right.
    """
    table = {r["node"]: r for r in nodes}

    def test(r: Row) -> str:
        slot = quote_name(r["feature_name"])
        left = r["left_categories"] if "left_categories" in r else None
        if left is not None:
            return f"{slot} IN ({', '.join(f'{float(c)!r}D' for c in left) or 'NULL'})"
        return f"{slot} <= {float(r['threshold'])!r}D"

    def walk(n: int) -> str:
        r = table[n]
        return leaf_value(r) if r["is_leaf"] else f"CASE WHEN {test(r)} THEN {walk(2 * n)} ELSE {walk(2 * n + 1)} END"

    return walk(1)


def leaf_column(nodes: Sequence[Row]) -> Column:
    """Heap id of the leaf that a row of slot columns reaches."""
    return F.expr(node_expression(nodes, lambda r: f"{r['node']}L"))


def node_counts(data: DataFrame, nodes: Sequence[Row]) -> DataFrame:
    """(node, rows) of every node that rows of ``data`` (with the slot columns) pass, from one count by leaf."""
    by_leaf = data.select(leaf_column(nodes).alias("leaf")).groupBy("leaf").agg(F.count(F.lit(1)).alias("rows"))
    depth = max(r["node"] for r in nodes).bit_length()
    up = F.transform(F.sequence(F.lit(0), F.lit(depth - 1)), lambda k: F.call_function("shiftright", F.col("leaf"), k))
    # at most one row a leaf from here on
    return by_leaf.select(F.explode(up).alias("node"), "rows").where("node > 0").groupBy("node").agg(F.sum("rows").alias("rows"))


def _cuts(conditions: Sequence[Row]) -> dict[str, list[float]]:
    out: dict[str, set[float]] = {}
    for c in conditions:
        out.setdefault(c["feature"], set()).add(float(c["threshold"]))
    return {f: sorted(t) for f, t in out.items()}


def rule_counts(data: DataFrame, conditions: Sequence[Row]) -> DataFrame:
    """(node, rows) of rules given as conditions (node, feature slot, op, threshold), any subset of any paths; node 1 has all rows.

    Rows are grouped into cells by how many of each feature's used cuts they exceed, so each is compared with every cut once;
    the rules, as many as the tree has leaves, are held against cells, not rows.
    """
    cuts = _cuts(conditions)
    place = {f: f"__c{i}" for i, f in enumerate(cuts)}

    def exceeded(f: str) -> str:
        # a null or NaN exceeds all, as when rows are routed
        return " + ".join(f"CASE WHEN {quote_name(f)} <= {t!r}D THEN 0 ELSE 1 END" for t in cuts[f])

    cells = data.select(*[F.expr(exceeded(f)).alias(c) for f, c in place.items()]).groupBy(*place.values()).agg(F.count(F.lit(1)).alias("rows"))
    rules: dict[int, list[str]] = {}
    for c in conditions:
        side = "<=" if c["op"] == "<=" else ">"
        rules.setdefault(c["node"], []).append(f"{place[c['feature']]} {side} {cuts[c['feature']].index(float(c['threshold']))}")
    met = ", ".join(["1L"] + [f"CASE WHEN {' AND '.join(tests)} THEN {node}L END" for node, tests in sorted(rules.items())])
    return cells.select(F.explode(F.expr(f"array_compact(array({met}))")).alias("node"), "rows").groupBy("node").agg(F.sum("rows").alias("rows"))
