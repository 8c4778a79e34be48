"""End-to-end segmentation jobs.

* :func:`segment_report` - clean, reduce, rank features with a random forest,
  keep the top N, fit a depth-5 tree on mixed features, report every leaf
  with its full root-to-leaf rule and integer percent.
* :func:`importance_job` - importance table for a caller's column list,
  every column indexed as a category.
* :func:`rules_job` - top-N columns from an importance table, all indexed as
  categories, parent-scope rules with the deepest condition per feature,
  float percent, and no report for trees with three leaves or fewer.

The working set is checkpointed into the shared folder once cleaned: the
top-N count pass and the model fits make several passes over it, and a lost
executor then re-reads the checkpoint instead of recomputing the scan.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segrules.functions.paths import clean_path, page_name_tail
from segrules.operators.features import feature_matrix, select_features
from segrules.operators.importance import random_forest_importance, top_feature_names
from segrules.operators.reduce import reduce_topn_multi
from segrules.operators.report import rule_report
from segrules.operators.tree import fit_segment_tree
from segrules.session import WorkingSet, cut_lineage
from segrules.sources.tables import project_columns, quote_name

# The reference's workload settings (category caps, features
# kept, and the forest/tree defaults of the two dataclasses below).
DEFAULT_REDUCE_CAPS = {"first_hit_pagename": 15, "post_prop11_concat": 25}
DEFAULT_NUM_FEATURES = 14


@dataclass(frozen=True)
class ForestParams:
    num_trees: int = 200
    max_depth: int = 10
    max_bins: int = 60
    impurity: str = "gini"
    max_categories: int = 20
    seed: int | None = None
    subsampling_rate: float = 1.0
    bootstrap: bool = True
    continuous: bool = False  # split index slots as numbers


#: One tree over all rows and features, index slots as numbers: no randomness, so its importances can be recomputed.
EXACT_FOREST = ForestParams(num_trees=1, max_depth=5, max_bins=64, bootstrap=False, continuous=True, seed=1)


@dataclass(frozen=True)
class TreeParams:
    max_depth: int = 5
    max_bins: int = 64
    seed: int = 42


def clean(df: DataFrame, path_column: str | None, page_column: str | None = None) -> DataFrame:
    """Drop incomplete rows, then clean the path column and trim the page column.

    Rows are dropped on the raw columns first: both derived columns are null
    exactly when their input is, and a null filter written after them would be
    pushed below the projection with the regular expressions copied into it
    (evaluated twice per row).
    """
    out = df.na.drop("any")
    if path_column:
        out = out.withColumn(path_column, clean_path(F.col(quote_name(path_column))))
    if page_column:
        out = out.withColumn(page_column, page_name_tail(F.col(quote_name(page_column))))
    return out


def reduce_long_tails(df: DataFrame, reduce_caps: Mapping[str, int]) -> DataFrame:
    return reduce_topn_multi(df, {c: n for c, n in reduce_caps.items() if c in df.columns})


def prepare(df: DataFrame, path_column: str | None, reduce_caps: Mapping[str, int]) -> DataFrame:
    """Drop incomplete rows, clean the path column, collapse long tails."""
    return reduce_long_tails(clean(df, path_column), reduce_caps)


def segment_report(
    df: DataFrame,
    response: str,
    path_column: str | None = "post_prop11_concat",
    reduce_caps: Mapping[str, int] = DEFAULT_REDUCE_CAPS,
    num_features: int = DEFAULT_NUM_FEATURES,
    forest: ForestParams = ForestParams(),
    tree: TreeParams = TreeParams(),
    exclude: Sequence[str] = (),
    page_column: str | None = None,
    with_label: bool = False,
) -> DataFrame:
    """The whole pipeline: one report row per leaf of the fitted tree.

    ``page_column`` (optional) is trimmed to its last ``|`` pair, as the
    landing page is in the reference's scan.  ``with_label`` adds predicted_label.
    The report (2^depth rows at most) stands by itself: all tables and caches of the run are released.
    """
    with WorkingSet(df.sparkSession) as work_set:
        return work_set.keep(
            _segment_report(df, response, path_column, reduce_caps, num_features, forest, tree, exclude, page_column, with_label)
        )


def _segment_report(
    df: DataFrame,
    response: str,
    path_column: str | None,
    reduce_caps: Mapping[str, int],
    num_features: int,
    forest: ForestParams,
    tree: TreeParams,
    exclude: Sequence[str],
    page_column: str | None,
    with_label: bool,
) -> DataFrame:
    work = clean(df.drop(*exclude), path_column, page_column)
    # only the cast can add nulls here: a bad response value drops its row
    work = work.withColumn(response, F.col(quote_name(response)).try_cast("double"))
    work = work.where(F.col(quote_name(response)).isNotNull() & ~F.isnan(quote_name(response)))
    # Cut before the reduction: the top-N count pass and every later fit read
    # the checkpoint; the reduction itself is a broadcast join against the
    # (cached, N-row) top lists applied on top of it.
    work = reduce_long_tails(cut_lineage(work), reduce_caps)
    # one indexing pass serves the forest and the tree
    fm = feature_matrix(work, response)
    importance = random_forest_importance(work, response, fm=fm, **asdict(forest))
    names = top_feature_names(importance, num_features)
    fitted = fit_segment_tree(
        work, response, max_depth=tree.max_depth, max_bins=tree.max_bins, seed=tree.seed,
        fm=select_features(fm, names),
    )
    return rule_report(fitted, scope="full", merge="all", style="print", min_leaves=2, with_label=with_label)


# The importance job sets no depth, so the forest runs at Spark's default depth 5.
IMPORTANCE_FOREST = ForestParams(max_depth=5, max_categories=10)


def importance_job(
    df: DataFrame, columns: Sequence[str], response: str, forest: ForestParams = IMPORTANCE_FOREST
) -> DataFrame:
    """Importance table of the listed columns, every one indexed as a category."""
    with WorkingSet(df.sparkSession) as work_set:
        work = project_columns(df, list(dict.fromkeys([*columns, response]))).na.drop("any")
        return work_set.keep(random_forest_importance(work, response, all_categorical=True, **asdict(forest)))


def rules_job(
    df: DataFrame,
    importance: DataFrame,
    num_features: int,
    response: str,
    tree: TreeParams = TreeParams(),
    min_leaves: int = 4,
) -> DataFrame:
    """Rules of the older jobs: parent scope, deepest condition per feature, float percent."""
    names = [n for n in top_feature_names(importance, num_features) if n != response]
    with WorkingSet(df.sparkSession) as work_set:
        work = project_columns(df, [*names, response]).na.drop("any")
        fitted = fit_segment_tree(
            work, response, features=names, max_depth=tree.max_depth, max_bins=tree.max_bins, seed=tree.seed,
            all_categorical=True,
        )
        return work_set.keep(rule_report(fitted, scope="parent", merge="last", style="sql", min_leaves=min_leaves, skip_empty=True))


def train_test_split(df: DataFrame, weights: Sequence[float] = (0.6, 0.4), seed: int = 11) -> list[DataFrame]:
    """Split by a hash of the whole row and the seed: the same rows whatever the layout, no shuffle.

    A row's place in [0, 1) is the first eight hexadecimal digits of the md5 of
    ``seed`` and its values as text (nulls as a mark of their own), divided by 2^32;
    the parts take their shares of ``weights`` in turn.  Equal rows stay together.
    """
    values = [F.coalesce(F.col(quote_name(c)).cast("string"), F.lit("\x00")) for c in df.columns]
    digits = F.substring(F.md5(F.concat_ws("\x01", F.lit(str(seed)), *values).cast("binary")), 1, 8)
    place = F.conv(digits, 16, 10).cast("double") / 2.0**32
    total, low, parts = float(sum(weights)), 0.0, []
    for i, w in enumerate(weights):
        high = low + w / total if i < len(weights) - 1 else 1.0
        parts.append(df.where((place >= low) & (place < high)))
        low = high
    return parts
