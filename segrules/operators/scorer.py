"""A tree that can be saved, loaded in another session and applied to any frame, batch or stream.

What is saved is a folder of three small or column-sized tables: the node table, the index of the nominal columns the
tree splits on, and one row that names the columns.  Scoring joins the index and evaluates one CASE
column; both work on streaming frames, whose rows are joined with the static index.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from segrules.operators.features import index_columns
from segrules.operators.routing import node_expression
from segrules.operators.tree import SegmentTree

_META = "nominal array<struct<column: string, labels: long>>, numeric array<string>, all_categorical boolean"


@dataclass
class SavedTree:
    """A loaded tree: node rows (2^(depth + 1) at most), the index table and the columns it reads."""

    nodes: list[Row]
    index: DataFrame
    nominal: dict[str, int]  # column -> number of labels
    numeric: list[str]
    all_categorical: bool

    @property
    def columns(self) -> list[str]:
        """Columns that a frame needs to be scored."""
        return [*self.numeric, *self.nominal]


def save_tree(tree: SegmentTree, path: str) -> None:
    """Write the tree as a folder; an existing one is replaced."""
    spark = tree.nodes.sparkSession
    used = {r["feature_name"] for r in tree.nodes.where("not is_leaf").select("feature_name").distinct().collect()}
    nominal = [tree.fm.nominal[s] for s in tree.fm.slots if s in used and s in tree.fm.nominal]
    numeric = [s for s in tree.fm.slots if s in used and s not in tree.fm.nominal]
    meta = [([(c, tree.fm.label_counts[c]) for c in nominal], numeric, tree.fm.all_categorical)]
    tree.nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    tree.fm.index.where(F.col("feature").isin(nominal)).write.mode("overwrite").parquet(f"{path}/index")
    spark.createDataFrame(meta, _META).coalesce(1).write.mode("overwrite").parquet(f"{path}/columns")


def load_tree(spark: SparkSession, path: str) -> SavedTree:
    meta = spark.read.parquet(f"{path}/columns").first()
    return SavedTree(
        nodes=spark.read.parquet(f"{path}/nodes").collect(),
        index=spark.read.parquet(f"{path}/index"),
        nominal={r["column"]: r["labels"] for r in meta["nominal"]},
        numeric=list(meta["numeric"]),
        all_categorical=meta["all_categorical"],
    )


def score_column(nodes: Sequence[Row]) -> Column:
    """Struct (node, prediction, predicted_label, probability) of the leaf that a row of slot columns reaches."""

    def leaf(r: Row) -> str:
        label = "cast(null as string)" if r["predicted_label"] is None else "'" + r["predicted_label"].replace("\\", "\\\\").replace("'", "\\'") + "'"
        return (
            f"named_struct('node', {r['node']}, 'prediction', {r['prediction']!r}D, "
            f"'predicted_label', {label}, 'probability', {r['probability']!r}D)"
        )

    return F.expr(node_expression(nodes, leaf))


def score_frame(tree: SavedTree, df: DataFrame, unseen: str = "error") -> DataFrame:
    """``df`` with node, prediction, predicted_label and probability; names among its columns that clash are replaced.

    ``unseen`` says what a category does that the tree's index lacks (or a null): ``error`` raises when the row is
    read, ``keep`` takes it as one more label after the last (it fails every ``idx <= cut``), ``skip`` drops the row.
    A null or NaN in a numeric column fails every ``<=``.

    A projection over one join per nominal column the tree uses; no shuffle while Spark's size check lets the index be broadcast.
    """
    columns = [*df.columns]
    # Columns get safe names first, so a frame may have any others, called like slots or dotted.
    numbered = df.toDF(*[f"__s{i}" for i in range(len(columns))])
    at = {c: f"__s{columns.index(c)}" for c in tree.columns}
    work = numbered.select("*", *[F.col(at[c]).cast("double" if c in tree.numeric else "string").alias(c) for c in tree.columns])
    work = index_columns(work, tree.index, list(tree.nominal), unseen, tree.nominal)
    scored = work.select(*[F.col(f"__s{i}") for i in range(len(columns))], score_column(tree.nodes).alias("__leaf"))
    added = ["node", "prediction", "predicted_label", "probability"]
    kept = [F.col(f"__s{i}").alias(c) for i, c in enumerate(columns) if c not in added]
    return scored.select(*kept, *[F.col(f"__leaf.{c}").alias(c) for c in added])
