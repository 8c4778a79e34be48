"""Shallow decision tree: fit, node table, row scores, leaf statistics.

Two-class gini trees are fit as a variance regressor on the 0/1 label index:
for two classes gini = 2p(1-p) = 2 * variance, so every split choice is the
same, and sibling leaves are only merged when their means are equal (the
classifier merges siblings that merely predict the same class, which loses
leaves the segmentation reports).  The feature vector is stripped of its ML
attributes so every slot is split as continuous, indexed categories included.

The fitted model is read back as a table: the model is saved into the shared
checkpoint folder and its node parquet is scanned.  Node ids there are
pre-order; a walk over the (at most 2^(depth+1)-1 rows) node table maps
them to heap ids (root 1, children 2n and 2n+1), which number the
segments in reports.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.regression import DecisionTreeRegressionModel, DecisionTreeRegressor
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from segrules.operators.features import FeatureMatrix, feature_matrix, fit_input, plain_vector
from segrules.session import cut_lineage, shared_path
from segrules.sources.tables import quote_name

PLAIN_FEATURES = "features_plain"
LEAF_COL = "leaf"


@dataclass
class SegmentTree:
    fm: FeatureMatrix
    model: DecisionTreeRegressionModel
    nodes: DataFrame
    max_depth: int

    @property
    def data(self) -> DataFrame:
        """Indexed input with the plain feature vector the tree was fit on."""
        return self.fm.data.withColumn(PLAIN_FEATURES, plain_vector(self.fm.slots))

    @property
    def leaves(self) -> DataFrame:
        return self.nodes.where("is_leaf")


def fit_segment_tree(
    df: DataFrame,
    response: str,
    features: Sequence[str] | None = None,
    max_depth: int = 5,
    max_bins: int = 64,
    seed: int = 42,
    all_categorical: bool = False,
    min_instances_per_node: int = 1,
    keep: Sequence[str] = (),
    fm: FeatureMatrix | None = None,
) -> SegmentTree:
    """Index, assemble and fit; returns the model with its node table.

    The response has two classes at most (one gives a single leaf); more raise.
    The trainer takes candidate thresholds from a sample of rows when a slot has more values
    than ``max_bins`` (at least ``max_bins`` squared and 10,000 rows, MLlib's bound).

    Pass an already fitted ``fm`` (see ``features.select_features``) to skip
    the indexing pass; ``df`` is then ignored.
    """
    if fm is None:
        fm = feature_matrix(df, response, features=features, all_categorical=all_categorical, keep=keep)
    if len(fm.response_labels) > 2:
        raise ValueError(f"the response needs two classes, {response!r} has {len(fm.response_labels)}")
    # The fit reads its input several times before MLlib caches its own
    # binned points (metadata, split candidates, first level), so the narrow
    # (label, vector) frame is kept for the duration of the fit.
    train = fm.data.select(F.col(quote_name(fm.label_col)).alias("label"), plain_vector(fm.slots).alias(PLAIN_FEATURES))
    reg = DecisionTreeRegressor(
        featuresCol=PLAIN_FEATURES,
        labelCol="label",
        impurity="variance",
        maxDepth=max_depth,
        maxBins=max_bins,
        minInstancesPerNode=min_instances_per_node,
        seed=seed,
        leafCol=LEAF_COL,
    )
    with fit_input(train, fm.rows) as points:
        model = reg.fit(points)
    nodes = node_table(model, fm.slots, fm.response_labels)
    return SegmentTree(fm=fm, model=model, nodes=nodes, max_depth=max_depth)


def _heap_walk(raw: DataFrame, depth: int) -> DataFrame:
    """(id, node, depth): heap id of every pre-order node id, root 1, children 2n and 2n+1.

    Unrolled to the model's depth as a chain of joins against the edge list
    (at most 2^(depth+1)-2 rows, broadcast), so the walk is one plan and one
    job instead of one job per level.
    """
    edges = F.broadcast(
        raw.select(
            F.col("id").alias("parent"),
            F.explode(
                F.array(
                    F.struct(F.col("leftChild").alias("child"), F.lit(0).alias("dir")),
                    F.struct(F.col("rightChild").alias("child"), F.lit(1).alias("dir")),
                )
            ).alias("e"),
        )
        .select("parent", "e.child", "e.dir")
        .where(F.col("child") >= 0)
    )
    level = raw.where(F.col("id") == 0).select("id", F.lit(1).cast("long").alias("node"), F.lit(0).alias("depth"))
    levels = [level]
    for _ in range(depth):
        level = level.join(edges, level["id"] == edges["parent"]).select(
            F.col("child").alias("id"), (F.col("node") * 2 + F.col("dir")).alias("node"), (F.col("depth") + 1).alias("depth")
        )
        levels.append(level)
    walk = levels[0]
    for lv in levels[1:]:
        walk = walk.unionByName(lv)
    return walk


def node_table(model: DecisionTreeRegressionModel, slots: Sequence[str], labels: Sequence[str] = ()) -> DataFrame:
    """One row per tree node (heap-numbered), with class statistics and split.

    Columns: node, depth, is_leaf, leaf_index (pre-order among leaves, as the
    model's ``leafCol``), count, p (share of label index 1), prediction (label
    index, 1 only when p > 0.5), predicted_label, probability of the predicted
    class, gini impurity 2p(1-p), gain (gini), feature_index, feature_name
    (assembler input column), threshold (left branch is ``<=``).
    """
    spark = SparkSession.getActiveSession()
    path = shared_path(spark, "segment-tree")
    model.write().overwrite().save(path)
    raw = spark.read.parquet(f"{path}/data")
    walked = raw.join(_heap_walk(raw, model.depth), "id")
    p = F.col("impurityStats")[1] / F.col("impurityStats")[0]
    is_leaf = F.col("leftChild") < 0
    pred = F.when(F.col("p") > 0.5, F.lit(1.0)).otherwise(F.lit(0.0))
    label_arr = F.array(*[F.lit(str(x)) for x in labels]) if labels else F.array().cast("array<string>")
    slot_arr = F.array(*[F.lit(s) for s in slots])
    nodes = walked.select(
        F.col("node").cast("int").alias("node"),
        F.col("depth").cast("int").alias("depth"),
        is_leaf.alias("is_leaf"),
        F.col("id").alias("_preorder"),
        F.col("rawCount").alias("count"),
        p.alias("p"),
        F.when(is_leaf, None).otherwise(F.col("gain") * 2).alias("gain"),
        F.when(is_leaf, None).otherwise(F.col("split.featureIndex")).alias("feature_index"),
        F.when(is_leaf, None).otherwise(F.col("split.leftCategoriesOrThreshold")[0]).alias("threshold"),
    )
    # A window over the node table (model-sized, at most 2^depth leaves).
    w = Window.partitionBy("is_leaf").orderBy("_preorder")
    table = nodes.select(
        "node",
        "depth",
        "is_leaf",
        F.when(F.col("is_leaf"), F.row_number().over(w) - 1).cast("int").alias("leaf_index"),
        "count",
        "p",
        pred.alias("prediction"),
        F.try_element_at(label_arr, pred.cast("int") + 1).alias("predicted_label"),
        F.greatest(F.col("p"), 1 - F.col("p")).alias("probability"),
        (2 * F.col("p") * (1 - F.col("p"))).alias("impurity"),
        "gain",
        "feature_index",
        F.try_element_at(slot_arr, F.col("feature_index") + 1).alias("feature_name"),
        "threshold",
    )
    # Written next to the model (a few dozen rows): later uses skip the walk.
    return cut_lineage(table.coalesce(1), "nodes")


def score_rows(tree: SegmentTree, keep: Sequence[str] = ()) -> DataFrame:
    """Per-row leaf, prediction (label index) and probability of the predicted class.

    A narrow map over the data (the model is broadcast inside ``transform``).
    """
    out = tree.model.transform(tree.data)
    p = F.col("prediction")
    return out.select(
        *[F.col(quote_name(k)) for k in keep],
        F.col(LEAF_COL).cast("int").alias("leaf_index"),
        F.when(p > 0.5, F.lit(1.0)).otherwise(F.lit(0.0)).alias("prediction"),
        F.greatest(p, 1 - p).alias("probability"),
    )


def leaf_stats(tree: SegmentTree) -> DataFrame:
    """Leaf statistics recounted from the data: group rows by leaf, average the label.

    One aggregation keyed by leaf (at most 2^depth groups, partial
    aggregation per task), joined to the leaf table for heap ids.
    """
    scored = tree.model.transform(tree.data)
    y = F.col(quote_name(tree.fm.label_col))
    stats = scored.groupBy(F.col(LEAF_COL).cast("int").alias("leaf_index")).agg(
        F.count(F.lit(1)).alias("coverage"), F.avg(y).alias("p")
    )
    leaves = tree.leaves.select("node", "leaf_index")
    return stats.join(F.broadcast(leaves), "leaf_index").select(
        "node",
        F.when(F.col("p") > 0.5, F.lit(1.0)).otherwise(F.lit(0.0)).alias("prediction"),
        F.greatest(F.col("p"), 1 - F.col("p")).alias("probability"),
        (2 * F.col("p") * (1 - F.col("p"))).alias("impurity"),
        "coverage",
    )
