"""Leaf paths, readable conditions and predicates.

With heap ids the path of a leaf needs no tree walk: for a leaf ``h`` at
depth ``d`` the node entered at step ``j`` is ``h >> j`` and its parent is
``h >> (j + 1)``; the branch is left (``<=``) when ``h >> j`` is even.  So a
leaf's conditions come from one explode and one equi-join with the internal
nodes.

Scopes (which inbound conditions a leaf's rule holds):

* ``full``   - every condition from the root to the leaf (default).
* ``parent`` - stops at the leaf's parent, so sibling leaves share a rule.
* ``leaf``   - same conditions as ``full``.

``merge='last'`` keeps, per feature, only the deepest condition (this can
widen a rule: ``x <= 8`` then ``x > 4`` keeps only ``x > 4``);
``merge='all'`` keeps every condition.

A condition on an indexed category (``idx <= t``) is expanded to the list of
category values on that side, ordered by index, joined from the index table by
the intervals between the cuts that the rules use.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from segrules.operators.features import condition_values, interval_values
from segrules.operators.tree import SegmentTree
from segrules.sources.tables import quote_name

SCOPES = ("full", "parent", "leaf")
MERGES = ("all", "last")
LEFT, RIGHT = "<=", ">"


def flip(op: Column) -> Column:
    """``<=`` <-> ``>``."""
    return F.when(F.trim(op) == LEFT, F.lit(RIGHT)).otherwise(F.lit(LEFT))


def leaf_conditions(nodes: DataFrame, scope: str = "full", merge: str = "all") -> DataFrame:
    """(node, level, feature, op, threshold): the conditions of each leaf's rule.

    ``level`` is the depth of the node the condition leads into (1 = a child
    of the root).  Works on the node table only (model-sized).
    """
    if scope not in SCOPES or merge not in MERGES:
        raise ValueError(f"scope in {SCOPES}, merge in {MERGES}")
    start = 1 if scope == "parent" else 0
    leaves = nodes.where("is_leaf").select("node", "depth")
    steps = leaves.where(F.col("depth") > start).select(
        "node", "depth", F.explode(F.sequence(F.lit(start), F.col("depth") - 1)).alias("j")
    )
    entered = F.expr("shiftright(node, j)")
    steps = steps.select(
        "node",
        (F.col("depth") - F.col("j")).alias("level"),
        F.expr("shiftright(node, j + 1)").cast("int").alias("parent"),
        F.when(entered % 2 == 0, F.lit(LEFT)).otherwise(F.lit(RIGHT)).alias("op"),
    )
    splits = nodes.where(~F.col("is_leaf")).select(
        F.col("node").alias("parent"), F.col("feature_name").alias("feature"), "threshold"
    )
    conds = steps.join(splits, "parent").select("node", "level", "feature", "op", "threshold")
    if merge == "last":
        w = Window.partitionBy("node", "feature").orderBy(F.desc("level"))
        conds = conds.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")
    return conds


def leaf_rules(tree: SegmentTree, scope: str = "full", merge: str = "all") -> DataFrame:
    """(node, rule_list) with rule_list an array of condition structs, root first.

    Struct fields: level, feature (vector slot), column (source column), op,
    threshold, nominal, values (category values on the branch's side, by
    index; empty for numeric conditions).
    """
    conds = leaf_conditions(tree.nodes, scope, merge)
    nominal = dict(tree.fm.nominal)
    values = F.array().cast("array<string>")
    if nominal:
        src = F.create_map(*[F.lit(x) for kv in nominal.items() for x in kv])
        conds = conds.withColumn("column", F.coalesce(F.try_element_at(src, F.col("feature")), F.col("feature")))
        conds = conds.withColumn("nominal", F.col("feature").isin(list(nominal)))
        sides = conds.where("nominal").select("node", "level", F.col("column").alias("feature"), "op", "threshold")
        cuts = sides.select("feature", "threshold")
        matched = condition_values(sides, interval_values(tree.fm.index, cuts), cuts, ["node", "level"])
        conds = conds.join(matched, ["node", "level"], "left").withColumn("values", F.coalesce(F.col("values"), values))
    else:
        conds = conds.withColumn("column", F.col("feature")).withColumn("nominal", F.lit(False)).withColumn("values", values)
    cond = F.struct("level", "feature", "column", "op", "threshold", "nominal", "values")
    return conds.groupBy("node").agg(F.array_sort(F.collect_list(cond)).alias("rule_list"))


def _threshold_text(c: Column) -> Column:
    return c["threshold"].cast("string")


def _quoted_values(c: Column, quote: str) -> Column:
    return F.concat(F.lit(quote), F.array_join(c["values"], f"{quote},{quote}"), F.lit(quote))


def rule_text(rule_list: Column | str, style: str = "print", rename: Mapping[str, str] | None = None) -> Column:
    """Readable text of a rule.

    * ``print``: deepest condition first, ``"  &&  "`` between,
      ``COLUMN : ["a","b"]`` / ``COLUMN <= 30.5`` (upper-case names).
    * ``sql``: root first, ``" and "`` between, ``(column in (a,b))`` /
      ``(column <= 30.5)``, no quotes or backticks.
    * ``html``: as ``sql`` with ``" <br> "`` between and display renames.
    * ``where``: a Spark SQL predicate for ``DataFrame.where`` (quoted names,
      escaped literals), root first.
    """
    rl = F.col(rule_list) if isinstance(rule_list, str) else rule_list
    if style == "print":

        def fmt(c: Column) -> Column:
            name = F.upper(c["column"])
            nominal = F.concat(name, F.lit(" : ["), _quoted_values(c, '"'), F.lit("]"))
            numeric = F.concat(name, F.lit(" "), c["op"], F.lit(" "), _threshold_text(c))
            return F.when(c["nominal"], nominal).otherwise(numeric)

        return F.array_join(F.transform(F.reverse(rl), fmt), "  &&  ")
    if style in ("sql", "html"):
        renames = rename or {}

        def fmt(c: Column) -> Column:
            name = c["column"]
            if renames:
                m = F.create_map(*[F.lit(x) for kv in renames.items() for x in kv])
                name = F.coalesce(F.try_element_at(m, name), name)
            nominal = F.concat(F.lit("("), name, F.lit(" in ("), F.array_join(c["values"], ","), F.lit("))"))
            numeric = F.concat(F.lit("("), name, F.lit(" "), c["op"], F.lit(" "), _threshold_text(c), F.lit(")"))
            return F.when(c["nominal"], nominal).otherwise(numeric)

        return F.array_join(F.transform(rl, fmt), " and " if style == "sql" else " <br> ")
    if style == "where":

        def literal(v: Column) -> Column:
            escaped = F.replace(F.replace(v, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'"))
            return F.concat(F.lit("'"), escaped, F.lit("'"))

        def fmt(c: Column) -> Column:
            name = F.concat(F.lit("`"), F.replace(c["column"], F.lit("`"), F.lit("``")), F.lit("`"))
            values = F.array_join(F.transform(c["values"], literal), ", ")
            nominal = F.when(F.size(c["values"]) == 0, F.lit("false")).otherwise(
                F.concat(F.lit("("), name, F.lit(" in ("), values, F.lit("))"))
            )
            numeric = F.concat(F.lit("("), name, F.lit(" "), c["op"], F.lit(" "), _threshold_text(c), F.lit(")"))
            return F.when(c["nominal"], nominal).otherwise(numeric)

        return F.coalesce(F.array_join(F.transform(rl, fmt), " and "), F.lit("true"))
    raise ValueError("style is one of print, sql, html, where")


def condition_predicate(cond: Row) -> Column:
    """Predicate of one condition on the source columns.

    An empty value list matches nothing (``lit(False)``), never the blank value.
    """
    col = F.col(quote_name(cond["column"]))
    if cond["nominal"]:
        vals = list(cond["values"] or [])
        return col.isin(vals) if vals else F.lit(False)
    return col <= F.lit(cond["threshold"]) if cond["op"] == LEFT else col > F.lit(cond["threshold"])


def rule_predicate(conds: Sequence[Row]) -> Column:
    """Conjunction of a rule's conditions (``TRUE`` for an empty rule)."""
    preds = [condition_predicate(c) for c in conds]
    return reduce(lambda a, b: a & b, preds) if preds else F.lit(True)
