"""Feature ranking: random-forest importance and top-N selection."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorIndexer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from segrules.operators.features import FIT_IN_MEMORY, FeatureMatrix, feature_matrix, fit_input, plain_vector, slot_names
from segrules.operators.forest import can_grow, grow_forest, slot_values
from segrules.operators.routing import node_counts
from segrules.session import checkpoint_root, cut_lineage, shared_path
from segrules.sources.tables import quote_name

IMPORTANCE_SCHEMA = "feature_name string, importance double"

#: Bootstrap counts (rows times trees) that one fit holds, and the trees it grows at least.
BAG_COUNTS = 200_000_000
LEAST_TREES = 10
#: Node ids (rows times trees) that a fit caches, three generations of them; with more, or beyond ``FIT_IN_MEMORY`` rows, rows walk
#: down the trees again.
NODE_IDS = 200_000_000
#: Bootstrap counts (rows times trees) from which a forest of ``LEAST_TREES`` or more is grown over binned rows.
GROWN_COUNTS = 20_000_000
SEED_STEP = 1_000_003  # between groups; MLlib adds the partition's number to a seed


@dataclass
class FittedForest:
    fm: FeatureMatrix
    model: RandomForestClassificationModel
    categories: dict[int, list[float]]  # slots that the indexer numbered anew -> their values by number
    more: list[RandomForestClassificationModel] = field(default_factory=list)  # the trees grown after those of ``model``

    @property
    def models(self) -> list[RandomForestClassificationModel]:
        return [self.model, *self.more]

    def importances(self) -> list[float]:
        """Importance by slot: each tree's brought to a sum of 1, added over all trees, and the total brought to 1 again."""
        total = sum(t.featureImportances.toArray() for m in self.models for t in m.trees)
        return list(total / (total.sum() or 1.0))


def tree_groups(rows: int, num_trees: int) -> list[int]:
    """Sizes of the groups of trees that are grown together: MLlib holds a count per row and tree of a group."""
    at_once = max(LEAST_TREES, BAG_COUNTS // max(rows, 1))
    groups = -(-num_trees // at_once)
    return [num_trees // groups + (i < num_trees % groups) for i in range(groups)]


def fit_forest(
    df: DataFrame,
    response: str,
    features: Sequence[str] | None = None,
    num_trees: int = 200,
    max_depth: int = 10,
    max_bins: int = 60,
    impurity: str = "gini",
    max_categories: int = 20,
    seed: int | None = None,
    all_categorical: bool = False,
    max_memory_mb: int = 1024,
    checkpoint_interval: int = 10,
    subsampling_rate: float = 1.0,
    fm: FeatureMatrix | None = None,
    bootstrap: bool = True,
    continuous: bool = False,
) -> FittedForest:
    """A random forest over the feature matrix.

    Strings (and the response) are frequency-indexed, numerics assembled
    first, slots with at most ``max_categories`` values marked categorical by
    ``VectorIndexer``; with ``continuous`` every slot is split as a number, indexes too.  One tree sees all
    features at every node, and without ``bootstrap`` all rows: such a forest has no randomness.

    Like the tree's, the forest's candidate thresholds come from a sample of rows
    when a slot has more values than ``max_bins``.

    Trees are independent, so on many rows they are grown in groups (:func:`tree_groups`), each over all rows with a seed of
    its own: MLlib caches a bootstrap count per row and tree, which for all trees at once would be many times the input.
    From ``GROWN_COUNTS`` rows times trees, forests for two classes are grown over binned rows instead (:mod:`segrules.operators.forest`), by MLlib's
    rules and as MLlib's model, all trees at once; the random numbers differ, and of the scale knobs only ``subsampling_rate`` applies.

    Scale knobs: ``max_memory_mb`` bounds the per-task histogram memory; a
    larger budget aggregates more tree nodes per pass, so fewer passes over
    the data.  Node ids per row are cached and checkpointed into the shared
    folder every ``checkpoint_interval`` iterations, which keeps lineage short
    for deep forests and lets a lost executor resume from the checkpoint.  Beyond ``FIT_IN_MEMORY`` rows, where they
    would be larger than the rows and spill, they are not kept: a row walks down each tree again at every level.
    ``subsampling_rate`` below 1 bags each tree on that share of the rows
    (default 1.0: every tree sees a bootstrap sample of all rows).
    """
    if fm is None:
        fm = feature_matrix(df, response, features=features, all_categorical=all_categorical)
    groups = tree_groups(fm.rows, num_trees)
    indexer = VectorIndexer(inputCol="features", outputCol="indexed", maxCategories=max_categories)
    params = dict(
        labelCol="label",
        featuresCol="features" if continuous else "indexed",
        maxDepth=max_depth,
        maxBins=max_bins,
        impurity=impurity,
        maxMemoryInMB=max_memory_mb,
        cacheNodeIds=fm.rows <= FIT_IN_MEMORY and fm.rows * max(groups) <= NODE_IDS,
        checkpointInterval=checkpoint_interval if fm.rows <= FIT_IN_MEMORY else -1,
        subsamplingRate=subsampling_rate,
        bootstrap=bootstrap,
        # what "auto" means for the whole forest, whatever the size of a group
        featureSubsetStrategy="all" if num_trees == 1 else "sqrt",
    )
    checkpoint_root(df.sparkSession)
    first = RandomForestClassifier().getSeed() if seed is None else seed
    vector = plain_vector(fm.slots).alias("features") if continuous else F.col(fm.output_col).alias("features")
    # Kept for the fit: the indexer pass and the first passes of each group of trees read it
    # before MLlib caches its binned points.
    train = fm.data.select(F.col(quote_name(fm.label_col)).alias("label"), vector)
    numbered, models = {}, []
    with fit_input(train, fm.rows) as points:
        if not continuous:
            indexed = indexer.fit(points)
            # at most ``max_categories`` numbers a slot
            numbered = {slot: sorted(m, key=m.get) for slot, m in indexed.categoryMaps.items()}
            points = indexed.transform(points)
        whole = RandomForestClassifier(numTrees=num_trees, seed=first, **{**params, "cacheNodeIds": False, "checkpointInterval": -1})
        values = slot_values(points, whole.getFeaturesCol(), len(fm.slots))
        if num_trees >= LEAST_TREES and fm.rows * num_trees >= GROWN_COUNTS and can_grow(whole, values, len(fm.response_labels)):
            return FittedForest(fm, grow_forest(whole, points, values, fm.rows), numbered)
        for i, trees in enumerate(groups):
            models.append(RandomForestClassifier(numTrees=trees, seed=first + i * SEED_STEP, **params).fit(points))
    return FittedForest(fm, models[0], numbered, models[1:])


def random_forest_importance(df: DataFrame, response: str, **forest) -> DataFrame:
    """(feature_name, importance) from a random forest, most important first; parameters as in :func:`fit_forest`.

    Training is MLlib's distributed level-wise histogram
    aggregation; only the importance vector (one value per feature) comes
    back, and is paired with the slot names read from the vector metadata,
    ordered by slot index.
    """
    fitted = fit_forest(df, response, **forest)
    names = slot_names(fitted.fm.data, fitted.fm.output_col)
    rows = [(fitted.fm.nominal.get(n, n), float(w)) for n, w in zip(names, fitted.importances())]
    return df.sparkSession.createDataFrame(rows, IMPORTANCE_SCHEMA).orderBy(F.desc("importance"), "feature_name")


def ensemble_nodes(fitted: FittedForest) -> DataFrame:
    """One row per node of every tree: tree, id, depth, node, is_leaf, count, impurity, gain, feature_index, feature_name, threshold,
    left_categories, prediction.

    The saved forest's own node table, in the shared folder.  ``node`` is the heap id (root 1, children 2n and
    2n + 1), found level by level from the edges, all trees at once.  A split on a number has a threshold (left is
    ``<=``), one on a categorical slot the slot's values that go left.  ``count`` is the node's training weight.
    """
    spark = fitted.fm.data.sparkSession
    raw, grown = None, 0
    for model in fitted.models:
        path = shared_path(spark, "forest")
        model.write().overwrite().save(path)
        group = spark.read.parquet(f"{path}/data").select((F.col("treeID") + grown).alias("tree"), "nodeData.*")
        raw, grown = group if raw is None else raw.unionByName(group), grown + model.getNumTrees
    inner = F.col("leftChild") >= 0
    edges = raw.where(inner).select(
        "tree", F.col("id").alias("parent"),
        F.explode(F.array(F.struct(F.col("leftChild").alias("child"), F.lit(0).alias("dir")), F.struct(F.col("rightChild").alias("child"), F.lit(1).alias("dir")))).alias("e"),
    ).select("tree", "parent", "e.child", "e.dir")
    level = raw.where("id = 0").select("tree", "id", F.lit(1).cast("long").alias("node"), F.lit(0).alias("depth"))
    walk = level
    for _ in range(max(t.depth for m in fitted.models for t in m.trees)):
        below = level.withColumnRenamed("id", "parent").join(edges, ["tree", "parent"]).select(
            "tree", F.col("child").alias("id"), (F.col("node") * 2 + F.col("dir")).alias("node"), (F.col("depth") + 1).alias("depth")
        )
        level = cut_lineage(below, "level")
        walk = walk.unionByName(level)
    slots = F.array(*[F.lit(s) for s in fitted.fm.slots])
    number = inner & (F.col("split.numCategories") < 0)
    sides = F.col("split.leftCategoriesOrThreshold")
    renumbered = [x for slot, values in fitted.categories.items() for x in (F.lit(slot), F.array(*[F.lit(float(v)) for v in values]))]
    if renumbered:
        own = F.try_element_at(F.create_map(*renumbered), F.col("split.featureIndex"))
        categories = F.transform(sides, lambda c: F.coalesce(F.get(own, c.cast("int")), c))
    else:
        categories = sides
    nodes = raw.join(walk, ["tree", "id"]).select(
        "tree", "id", "depth", "node", (~inner).alias("is_leaf"),
        F.aggregate("impurityStats", F.lit(0.0), lambda a, x: a + x).alias("count"), "impurity",
        F.when(inner, F.col("gain")).alias("gain"),
        F.when(inner, F.col("split.featureIndex")).alias("feature_index"),
        F.when(inner, F.get(slots, F.col("split.featureIndex"))).alias("feature_name"),
        F.when(number, F.get(sides, F.lit(0))).alias("threshold"),
        F.when(inner & ~number, categories).alias("left_categories"),
        "prediction",
    )
    return cut_lineage(nodes, "forest-nodes")


def ensemble_importance(nodes: DataFrame, fm: FeatureMatrix) -> DataFrame:
    """(feature_name, importance, splits) from the node table, by grouped sums: in each tree a split adds its gain times its
    count to its feature, trees are brought to a sum of 1, added, and the total is brought to 1 again.

    Features that no tree splits on have importance 0.  Names go by the slot's index, index columns by their source.
    """
    split = nodes.where(~F.col("is_leaf"))
    per_tree = split.groupBy("tree", "feature_index").agg(F.sum(F.col("gain") * F.col("count")).alias("w"), F.count("*").alias("k"))
    whole = per_tree.groupBy("tree").agg(F.sum("w").alias("all"))
    shares = per_tree.join(whole, "tree").groupBy("feature_index").agg(
        F.sum(F.when(F.col("all") > 0, F.col("w") / F.col("all")).otherwise(0.0)).alias("share"), F.sum("k").alias("splits")
    )
    spark = nodes.sparkSession
    named = spark.createDataFrame([(i, fm.nominal.get(s, s)) for i, s in enumerate(fm.slots)], "feature_index int, feature_name string")
    joined = named.join(shares, "feature_index", "left")
    # a window over one row a feature
    joined = joined.withColumn("total", F.sum("share").over(Window.partitionBy()))
    value = F.when(F.col("total") > 0, F.col("share") / F.col("total"))
    return joined.select(
        "feature_name", F.coalesce(value, F.lit(0.0)).alias("importance"), F.coalesce("splits", F.lit(0)).cast("long").alias("splits")
    )


def recount_nodes(nodes: DataFrame, data: DataFrame, tree: int = 0) -> DataFrame:
    """(node, rows): how many rows of ``data`` pass each node of one tree of the node table, counted by routing them."""
    table = nodes.where(F.col("tree") == tree).collect()  # one tree's nodes
    return node_counts(data, table)


def select_top_features(importance: DataFrame, n: int, response: str | None = None, drop_response: bool = False) -> DataFrame:
    """(feature_name, position): the ``n`` most important features, then the response.

    Ties break by name.  ``drop_response=True`` removes the response *after*
    the limit, as the older jobs do, so fewer than ``n`` features may remain.
    """
    w = Window.orderBy(F.desc("importance"), F.asc("feature_name"))
    top = importance.orderBy(F.desc("importance"), F.asc("feature_name")).limit(n)
    top = top.select("feature_name", F.row_number().over(w).alias("position"))
    if response is not None:
        if drop_response:
            top = top.where(F.col("feature_name") != F.lit(response))
        last = top.agg(F.coalesce(F.max("position"), F.lit(0)).alias("m")).select(
            F.lit(response).alias("feature_name"), (F.col("m") + 1).cast("int").alias("position")
        )
        top = top.unionByName(last)
    return top


def top_feature_names(importance: DataFrame, n: int, response: str | None = None, drop_response: bool = False) -> list[str]:
    """Names of :func:`select_top_features` in order (at most n + 1 names reach the driver)."""
    rows = select_top_features(importance, n, response, drop_response).orderBy("position").collect()
    return [r["feature_name"] for r in rows]
