"""Leaf report: prediction, probability, readable rule, coverage, frequency.

Coverage comes from routing the rows down the tree (:mod:`segrules.operators.routing`): one count by
leaf, and sums over the node table.  ``coverage_counts`` counts given predicates instead, in one
aggregation: one ``count_if(rule_i)`` per rule plus the total, partially aggregated per task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StringType, StructField, StructType

from segrules.operators.routing import node_counts, rule_counts
from segrules.operators.rules import leaf_conditions, leaf_rules, rule_text
from segrules.operators.tree import SegmentTree

REPORT_SCHEMA = StructType(
    [
        StructField("node", IntegerType()),
        StructField("prediction", DoubleType()),
        StructField("probability", DoubleType()),
        StructField("rules", StringType()),
        StructField("coverage", LongType()),
        StructField("frequency", DoubleType()),
        StructField("frequency_pct", LongType()),
    ]
)


def coverage_counts(df: DataFrame, predicates: list[tuple[int, "F.Column"]]) -> DataFrame:
    """(node, coverage, total) for each (node, predicate) in one pass over ``df``."""
    aggs = [F.count(F.lit(1)).alias("total")]
    aggs += [F.count_if(p).alias(f"c{i}") for i, (_, p) in enumerate(predicates)]
    counted = df.agg(*aggs)
    pairs = ", ".join(f"{int(node)}, c{i}" for i, (node, _) in enumerate(predicates))
    return counted.selectExpr("total", f"stack({len(predicates)}, {pairs}) as (node, coverage)").select(
        F.col("node").cast("int").alias("node"), F.col("coverage").cast("long").alias("coverage"), "total"
    )


def frequency(coverage: F.Column, total: F.Column) -> F.Column:
    """Share of all rows in percent, as a double."""
    return coverage * F.lit(100.0) / total


def frequency_pct(coverage: F.Column, total: F.Column) -> F.Column:
    """Integer percent, truncated: ``(coverage * 100) div total``."""
    scaled = coverage * F.lit(100)
    return ((scaled - F.pmod(scaled, total)) / total).cast("long")


def rule_report(
    tree: SegmentTree,
    data: DataFrame | None = None,
    scope: str = "full",
    merge: str = "all",
    style: str = "print",
    min_leaves: int = 2,
    skip_empty: bool = True,
    rename: dict[str, str] | None = None,
    with_label: bool = False,
    invalid: str = "keep",
) -> DataFrame:
    """One row per leaf rule: node, prediction, probability, rules, coverage, frequency, frequency_pct.

    ``min_leaves``: trees with fewer leaves give an empty report (2 = only a
    single-leaf tree is dropped; 4 drops trees with three leaves or fewer).
    ``skip_empty``: leaves whose rule has no condition (parent scope, depth 1)
    are left out.  ``with_label`` adds predicted_label, the class that ``prediction`` numbers.
    ``data`` and ``invalid``: see :func:`leaf_coverage`.
    """
    spark = tree.nodes.sparkSession
    schema = StructType([*REPORT_SCHEMA.fields, *([StructField("predicted_label", StringType())] if with_label else [])])
    if tree.leaves.count() < max(min_leaves, 2):
        return spark.createDataFrame([], schema)
    rules = leaf_rules(tree, scope, merge).select("node", rule_text("rule_list", style, rename).alias("rules"))
    stats = tree.leaves.select("node", "prediction", "probability", "predicted_label")
    texts = stats.join(rules, "node", "inner" if skip_empty else "left").select("*", F.coalesce("rules", F.lit("")).alias("text")).drop("rules")
    cov = leaf_coverage(tree, data, scope, merge, invalid)
    return (
        cov.join(texts.withColumnRenamed("text", "rules"), "node")
        .select(
            F.col("node").cast("int"),
            "prediction",
            "probability",
            "rules",
            "coverage",
            frequency(F.col("coverage"), F.col("total")).alias("frequency"),
            frequency_pct(F.col("coverage"), F.col("total")).alias("frequency_pct"),
            *(["predicted_label"] if with_label else []),
        )
    )


def leaf_coverage(tree: SegmentTree, data: DataFrame | None = None, scope: str = "full", merge: str = "all", invalid: str = "keep") -> DataFrame:
    """(node, coverage, total): rows that each leaf's rule covers, in one pass over ``data`` and without a list of values.

    Whole paths, and the parent scope's that end one node higher, are node counts of the routed rows; with
    ``merge='last'`` a rule may cover more than its node, and is counted on cells of the used cuts.
    ``data`` (default: the rows the tree was fitted on) gets the tree's index first; values it lacks go by ``invalid``.
    """
    data = tree.fm.data if data is None else tree.fm.transform(data, invalid, with_response=False)
    nodes = tree.nodes.collect()  # at most 2^(depth + 1) rows
    leaves = tree.leaves.select("node", "depth")
    if merge == "all":
        counts = node_counts(data, nodes)
        at = F.when((F.lit(scope) == "parent") & (F.col("node") > 1), F.expr("shiftright(node, 1)")).otherwise(F.col("node"))
    else:
        conditions = leaf_conditions(tree.nodes, scope, merge).collect()  # at most depth of them a leaf
        counts = rule_counts(data, conditions)
        # the empty rule of the parent scope at depth 1 covers every row, as node 1 does
        at = F.when(F.col("node").isin(sorted({c["node"] for c in conditions})), F.col("node")).otherwise(1)
    # Each leaf meets its rule's count and, by node 1, that of all rows: one join of model-sized tables.
    own = F.struct(at.cast("long").alias("at"), F.lit(False).alias("all"))
    root = F.struct(F.lit(1).cast("long").alias("at"), F.lit(True).alias("all"))
    wanted = leaves.select("node", F.explode(F.array(own, root)).alias("w"))
    counted = wanted.select("node", "w.at", "w.all").join(counts.withColumnRenamed("node", "at"), "at", "left")
    return counted.groupBy("node").agg(
        F.coalesce(F.max(F.when(~F.col("all"), F.col("rows"))), F.lit(0)).cast("long").alias("coverage"),
        F.coalesce(F.max(F.when(F.col("all"), F.col("rows"))), F.lit(0)).cast("long").alias("total"),
    )
