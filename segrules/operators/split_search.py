"""Best gini cut per feature, exact at every number of distinct values.

The per-(feature, value) histogram is aggregated first (partial aggregation
per task, so a hot value is one counter per task), then sorted and
written with fixed partitions.  Running sums are taken inside each partition
and shifted by the sums of the partitions before it, so no task holds a whole
feature, however many values it has.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from segrules.session import cut_lineage
from segrules.sources.tables import quote_name


def gini(n: F.Column, pos: F.Column) -> F.Column:
    """Two-class gini impurity 2p(1-p) of a node with ``n`` rows, ``pos`` positive."""
    p = pos / n
    return F.lit(2.0) * p * (F.lit(1.0) - p)


def split_search(df: DataFrame, label: str, features: Sequence[str]) -> DataFrame:
    """(feature, threshold, gain, left_count, right_count): the best cut of each feature.

    ``label`` is 0/1; cuts lie midway between consecutive values; gain =
    gini(parent) - nL/n gini(left) - nR/n gini(right); rows ``<= threshold`` go
    left.  Ties keep the smaller threshold; nulls take no part.
    """
    pairs = ", ".join(f"'{f.replace(chr(39), chr(39) * 2)}', cast({quote_name(f)} as double)" for f in features)
    stacked = df.selectExpr(f"cast({quote_name(label)} as double) as y", f"stack({len(features)}, {pairs}) as (feature, value)")
    hist = stacked.where("value is not null").groupBy("feature", "value").agg(
        F.count(F.lit(1)).alias("n"), F.sum("y").alias("pos")
    )
    tagged = cut_lineage(hist.orderBy("feature", "value").withColumn("__pid", F.spark_partition_id()), "histogram")
    per = tagged.groupBy("feature", "__pid").agg(F.sum("n").alias("pn"), F.sum("pos").alias("pp"), F.min("value").alias("first"))
    parts = Window.partitionBy("feature").orderBy("__pid")
    before, whole = parts.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("feature")
    # one row per feature and partition, whatever the number of values
    offsets = per.select(
        "feature",
        "__pid",
        F.coalesce(F.sum("pn").over(before), F.lit(0)).alias("n0"),
        F.coalesce(F.sum("pp").over(before), F.lit(0.0)).alias("p0"),
        F.lead("first").over(parts).alias("next_first"),
        F.sum("pn").over(whole).alias("nt"),
        F.sum("pp").over(whole).alias("pt"),
    )
    local = Window.partitionBy("feature", "__pid").orderBy("value")
    upto = local.rowsBetween(Window.unboundedPreceding, 0)
    cuts = tagged.join(F.broadcast(offsets), ["feature", "__pid"]).select(
        "feature",
        ((F.col("value") + F.coalesce(F.lead("value").over(local), F.col("next_first"))) / 2).alias("threshold"),
        (F.col("n0") + F.sum("n").over(upto)).alias("nl"),
        (F.col("p0") + F.sum("pos").over(upto)).alias("pl"),
        "nt",
        "pt",
    ).where(F.col("threshold").isNotNull())
    nr, pr = F.col("nt") - F.col("nl"), F.col("pt") - F.col("pl")
    gain = (
        gini(F.col("nt"), F.col("pt"))
        - F.col("nl") / F.col("nt") * gini(F.col("nl"), F.col("pl"))
        - nr / F.col("nt") * gini(nr, pr)
    )
    best = cuts.groupBy("feature").agg(
        F.max(F.struct(gain.alias("gain"), (-F.col("threshold")).alias("low"), F.col("nl"), nr.alias("nr"))).alias("b")
    )
    return best.select(
        "feature",
        (-F.col("b.low")).alias("threshold"),
        "b.gain",
        F.col("b.nl").cast("long").alias("left_count"),
        F.col("b.nr").cast("long").alias("right_count"),
    )
