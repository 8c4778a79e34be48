"""Long-tail category reduction and value ranking.

The straightforward form ranks values with a window over *all rows* ordered by
(count desc, value desc) - a window without a partition key, which pulls the
whole table into one task.  Here the counts are aggregated first (partial
aggregation before the shuffle, so a value holding a third of the rows costs
one counter per task), the top N per column are cut with a grouped
``row_number`` that Spark turns into a partial ``WindowGroupLimit`` (at most N
rows per column leave each task), and the rows are labelled through a
broadcast join against that N-row list.  The broadcast side is bounded by the
caps the caller passes, not by the data.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from segrules.session import cut_lineage
from segrules.sources.tables import quote_name

# Labels the reduction writes, as in the reference.
OTHER = "Other"
UNKNOWN = "Unknown"


def _stacked(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Long form (feature, value) of several columns as strings, one generator pass."""
    columns = list(columns)
    pairs = ", ".join(f"'{c.replace(chr(39), chr(39) * 2)}', cast({quote_name(c)} as string)" for c in columns)
    return df.selectExpr(f"stack({len(columns)}, {pairs}) as (feature, value)")


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """(value, count) per distinct value; ``count(col)`` so the null group counts 0."""
    c = F.col(quote_name(column))
    return df.groupBy(c.alias("value")).agg(F.count(c).alias("count"))


def value_counts_window(df: DataFrame, column: str, keep: Iterable[str] = ()) -> DataFrame:
    """Every row with the count of its value (``count(c) over (partition by c)``).

    Written as aggregate-then-join instead of a window: a window cannot split
    a hot value, while the shuffled join can be split by AQE's skew handling
    (and the count table broadcasts by itself when Spark's size check allows).
    """
    counts = value_counts(df, column).withColumnRenamed("value", "__vc_value")
    rows = df.select(*[F.col(quote_name(k)) for k in keep], F.col(quote_name(column)).alias("value"))
    joined = rows.join(counts, rows["value"].eqNullSafe(counts["__vc_value"]), "left")
    return joined.select(*[F.col(quote_name(k)) for k in keep], "value", F.col("count"))


def global_row_number(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """1-based position of each row in a total order, without a single-task window.

    The rows are range-partitioned and sorted (distributed), written once to
    the shared checkpoint folder so partition ids are fixed, then each row's
    position is its partition's offset plus its position inside the
    partition.  Only one row per partition (its size) goes through a window.
    """
    tagged = cut_lineage(
        df.orderBy(*order)
        .withColumn("__pid", F.spark_partition_id())
        .withColumn("__mid", F.monotonically_increasing_id())
    )
    sizes = tagged.groupBy("__pid").agg(F.count(F.lit(1)).alias("__n"))
    w = Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("__pid", F.coalesce(F.sum("__n").over(w), F.lit(0)).alias("__off"))
    pos = F.col("__mid") - F.shiftleft(F.col("__pid").cast("long"), 33)
    # offsets has one row per partition of the sorted data: its size is the
    # partition count, independent of the row count.
    return (
        tagged.join(F.broadcast(offsets), "__pid")
        .withColumn(name, F.col("__off") + pos + 1)
        .drop("__pid", "__mid", "__off")
    )


def value_rank(df: DataFrame, column: str) -> DataFrame:
    """(value, count, rank): rank by count desc, then value desc, null last.

    (count, value) is unique per value, so dense rank and row number agree.
    """
    counts = value_counts(df, column)
    return global_row_number(counts, [F.desc("count"), F.desc_nulls_last("value")], "rank")


def top_values(df: DataFrame, caps: Mapping[str, int]) -> DataFrame:
    """(feature, value, count, rank) for the top ``caps[feature]`` values of each column.

    One aggregation for all columns.  The filter on ``row_number`` becomes a
    partial ``WindowGroupLimit`` below the shuffle on ``feature``, so each
    task forwards at most N rows per column.
    """
    caps = dict(caps)
    # Ties go by the value in its own type, so 10 comes before 9.
    numeric = [c for c in caps if isinstance(df.schema[c].dataType, NumericType)]
    counted = _stacked(df, caps).groupBy("feature", "value").agg(F.count("value").alias("count"))
    number = F.when(F.col("feature").isin(numeric), F.col("value").try_cast("decimal(38,9)")) if numeric else F.lit(None).cast("double")
    exact = F.when(F.col("feature").isin(numeric), F.col("value").try_cast("double")) if numeric else F.lit(None).cast("double")
    w = Window.partitionBy("feature").orderBy(
        F.desc("count"), F.desc_nulls_last(exact), F.desc_nulls_last(number), F.desc_nulls_last("value")
    )
    ranked = counted.withColumn("rank", F.row_number().over(w))
    cap = F.lit(None).cast("int")
    for name, n in caps.items():
        cap = F.when(F.col("feature") == F.lit(name), F.lit(int(n))).otherwise(cap)
    return ranked.where(F.col("rank") <= F.lit(max(caps.values()))).where(F.col("rank") <= cap)


def _relabel(value: Column, kept: Column) -> Column:
    """Out of the top N -> Other (tested first); blank -> Unknown; else unchanged (as a label string)."""
    value = value.cast("string")
    return F.when(~kept, F.lit(OTHER)).when(value == F.lit(""), F.lit(UNKNOWN)).otherwise(value)


def reduce_topn_multi(df: DataFrame, caps: Mapping[str, int] | Iterable[tuple[str, int]]) -> DataFrame:
    """Collapse each listed column to its top N values, in one counting pass.

    Reducing one column never changes another column's counts, so doing all
    columns from one aggregation equals reducing them one after another.
    """
    caps = dict(caps)
    if not caps:
        return df
    # The N-row lists are written to the shared folder: a lost executor then
    # re-reads them instead of repeating the counting pass over all rows.
    top = cut_lineage(top_values(df, caps).select("feature", "value"), "top-values")
    out = df
    for i, (name, _) in enumerate(caps.items()):
        v, k = f"__top_v{i}", f"__top_k{i}"
        kept = F.broadcast(top.where(F.col("feature") == F.lit(name)).select(F.col("value").alias(v), F.lit(True).alias(k)))
        out = out.join(kept, out[quote_name(name)].eqNullSafe(F.col(v)), "left")
        out = out.withColumn(name, _relabel(F.col(quote_name(name)), F.coalesce(F.col(k), F.lit(False)))).drop(v, k)
    return out.select(*[F.col(quote_name(c)) for c in df.columns])


def reduce_topn(df: DataFrame, column: str, n: int) -> DataFrame:
    """Collapse one column to its top ``n`` values by (count desc, value desc)."""
    return reduce_topn_multi(df, {column: n})
