"""Feature preparation: type split, frequency indexing, vector assembly.

Category indexes follow ``StringIndexer(stringOrderType='frequencyDesc')``:
most frequent value gets 0, ties break alphabetically.  The index is a table
(feature, value, count, idx): it is ranked with one distributed sort, so no task holds
a large feature's values, and applied by joins, so no label list reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass, field, replace

from pyspark import StorageLevel
from pyspark.ml.feature import VectorIndexer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from segrules.operators.reduce import _stacked, global_row_number
from segrules.session import cut_lineage
from segrules.sources.tables import quote_name

INDEX_SUFFIX = "_index"


def split_columns(df: DataFrame, response: str | None = None) -> tuple[list[str], list[str]]:
    """(categorical, numeric) feature names: strings are categorical, all else numeric.

    The response is excluded from both lists.  Reads the schema only.
    """
    cats = [f.name for f in df.schema.fields if isinstance(f.dataType, StringType) and f.name != response]
    nums = [f.name for f in df.schema.fields if not isinstance(f.dataType, StringType) and f.name != response]
    return cats, nums


def category_index(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(feature, value, count, idx): frequency-descending index per column, ties alphabetical.

    Beyond ``RANKED_IN_WINDOW`` distinct values (which one window a column ranks) they are ranked with one distributed
    sort over (feature, count desc, value), so a column with
    millions of distinct values is spread over many tasks; each feature's
    index is its global position minus the feature's first position (one
    row per feature, broadcast).
    """
    counted = _stacked(df, columns).where(F.col("value").isNotNull()).groupBy("feature", "value").agg(
        F.count(F.lit(1)).alias("count")
    )
    counted = cut_lineage(counted, "counts")
    if counted.count() <= RANKED_IN_WINDOW:
        w = Window.partitionBy("feature").orderBy(F.desc("count"), "value")
        return counted.select("feature", "value", "count", (F.row_number().over(w) - 1).cast("double").alias("idx"))
    ranked = global_row_number(counted, [F.asc("feature"), F.desc("count"), F.asc("value")], "__pos")
    first = ranked.groupBy("feature").agg(F.min("__pos").alias("__first"))
    return ranked.join(F.broadcast(first), "feature").select(
        "feature", "value", "count", (F.col("__pos") - F.col("__first")).cast("double").alias("idx")
    )


def category_lookup(indexed: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Distinct (feature, value, idx) pairs read back from an indexed frame."""
    parts = [
        indexed.select(
            F.lit(c).alias("feature"),
            F.col(quote_name(c)).cast("string").alias("value"),
            F.col(quote_name(c + INDEX_SUFFIX)).alias("idx"),
        )
        for c in columns
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


#: Up to so many distinct values altogether, the index is ranked by one window a column; more are sorted in a distributed way.
RANKED_IN_WINDOW = 100_000
#: Slots with more labels than a forest has bins carry no label count: they are split as numbers.
NOMINAL_LABELS = 60
#: Labels of the response that are named in results; a response with more classes is no class.
RESPONSE_LABELS = 100

#: Rows that a fit caches as they lie, and rows of a file when there are more of them.
FIT_IN_MEMORY = 1_000_000
FIT_FILE_ROWS = 32_768

INVALID = ("error", "keep", "skip")


def index_columns(df: DataFrame, index: DataFrame, columns: Sequence[str], invalid: str = "error", counts: dict[str, int] | None = None) -> DataFrame:
    """``df`` with ``<c>_index`` for each column, looked up in ``index`` (feature, value, idx).

    A value that the index lacks, and a null, ``error``s when the row is read, is ``keep``-ed as one more label after
    the last (``counts`` has the labels per column), or ``skip``s its row.

    The index is joined as the table it is and never listed on the driver: Spark broadcasts a column's part while
    its size check allows, else both sides are shuffled on the value and AQE splits the rows of a hot one.
    """
    if invalid not in INVALID:
        raise ValueError(f"invalid in {INVALID}")
    out = df
    for i, c in enumerate(columns):
        v, x = f"__iv{i}", f"__ix{i}"
        one = index.where(F.col("feature") == F.lit(c)).select(F.col("value").alias(v), F.col("idx").alias(x))
        out = out.join(one, F.col(quote_name(c)).cast("string") == F.col(v), "inner" if invalid == "skip" else "left")
        found = F.col(x)
        if invalid == "keep":
            found = F.coalesce(found, F.lit(float((counts or {})[c])))
        elif invalid == "error":
            unseen = F.concat(F.lit(f"no index for a value of column {c}: "), F.coalesce(F.col(quote_name(c)).cast("string"), F.lit("null")))
            found = F.coalesce(found, F.raise_error(unseen).cast("double"))
        out = out.withColumn(c + INDEX_SUFFIX, found).drop(v, x)
    return out


def assembled(slots: Sequence[str], label_counts: dict[str, int], output_col: str) -> F.Column:
    """Dense vector of the slot columns with their names (and how many labels an index slot has) as ML attributes.

    A null or NaN in a slot is an error, as in ``VectorAssembler``; names need no rules, dots included.
    """

    def slot(s: str) -> F.Column:
        x = F.col(quote_name(s)).cast("double")
        return F.when(x.isNull() | F.isnan(x), F.raise_error(F.lit(f"null or NaN in feature {s}")).cast("double")).otherwise(x)

    attrs: dict[str, list[dict]] = {"numeric": [], "nominal": []}
    for i, s in enumerate(slots):
        if 0 < label_counts.get(s, 0) <= NOMINAL_LABELS:
            attrs["nominal"].append({"idx": i, "name": s, "num_vals": label_counts[s]})
        else:
            attrs["numeric"].append({"idx": i, "name": s})
    metadata = {"ml_attr": {"attrs": {k: v for k, v in attrs.items() if v}, "num_attrs": len(slots)}}
    return array_to_vector(F.array(*[slot(s) for s in slots])).alias(output_col, metadata=metadata)


@dataclass
class FeatureMatrix:
    """A frequency index, the frame it was applied to and the slots of its vectors."""

    index: DataFrame  # (feature, value, count, idx), the response's labels included
    data: DataFrame
    slots: list[str]  # vector slot i -> column
    response: str
    nominal: dict[str, str] = field(default_factory=dict)  # indexed slot -> source column
    label_counts: dict[str, int] = field(default_factory=dict)  # source column -> number of labels
    response_labels: list[str] = field(default_factory=list)
    all_categorical: bool = False
    output_col: str = "features"
    rows: int = 0  # rows with a response, as the index counts them

    @property
    def label_col(self) -> str:
        return self.response + INDEX_SUFFIX

    def transform(self, df: DataFrame, invalid: str = "error", with_response: bool = True) -> DataFrame:
        """``df`` with the index columns and the vector, in one projection over the index joins."""
        cats = [*self.nominal.values(), *([self.response] if with_response else [])]
        counts = {**self.label_counts, self.response: len(self.response_labels)}
        slot_counts = {s: self.label_counts[c] + (invalid == "keep") for s, c in self.nominal.items()}
        out = index_columns(df, self.index, cats, invalid, counts)
        return out.select("*", assembled(self.slots, slot_counts, self.output_col))


def feature_matrix(
    df: DataFrame,
    response: str,
    features: Sequence[str] | None = None,
    all_categorical: bool = False,
    output_col: str = "features",
    keep: Sequence[str] = (),
) -> FeatureMatrix:
    """Index string features and the response, assemble numerics first, then indexed categories.

    ``all_categorical=True`` casts every feature to string first and indexes
    all of them (numbers included), as the older jobs do.  ``keep`` columns
    (row tags) ride along untouched.  One aggregation counts the values of all columns;
    the index stays a distributed table (written to the shared folder), whatever a column's number of values.
    Column names may hold any characters, dots too.
    """
    keep = [k for k in keep if k != response]
    cols = [c for c in features if c != response] if features else [c for c in df.columns if c != response and c not in keep]
    keep = [k for k in keep if k not in cols]  # a feature that is kept as well is there already
    work = df.select(*[F.col(quote_name(c)) for c in [*keep, *cols, response]])
    if all_categorical:
        work = work.select(
            *[F.col(quote_name(k)) for k in keep],
            *[F.col(quote_name(c)).cast("string").alias(c) for c in [*cols, response]],
        )
    cats, nums = split_columns(work.select(*[quote_name(c) for c in cols]))
    index = cut_lineage(category_index(work, [*cats, response]), "index")
    # one row a column
    counted = index.groupBy("feature").agg(F.count("*").alias("n"), F.sum("count").alias("rows")).collect()
    counts = {r["feature"]: r["n"] for r in counted}
    named = index.where(F.col("feature") == F.lit(response)).orderBy("idx").limit(RESPONSE_LABELS + 1).select("value").collect()
    fm = FeatureMatrix(
        index=index,
        data=work,
        slots=nums + [c + INDEX_SUFFIX for c in cats],
        response=response,
        nominal={c + INDEX_SUFFIX: c for c in cats},
        label_counts={c: counts.get(c, 0) for c in cats},
        response_labels=[r["value"] for r in named],
        all_categorical=all_categorical,
        output_col=output_col,
        rows=sum(r["rows"] for r in counted if r["feature"] == response),
    )
    fm.data = fm.transform(work)
    if sum(counts.values()) > RANKED_IN_WINDOW:
        fm.data = cut_lineage(fm.data, "indexed")  # joins with large indexes run once, not in every pass over the data
    return fm


def select_features(fm: FeatureMatrix, features: Sequence[str]) -> FeatureMatrix:
    """The same index and frame restricted to ``features`` (numerics first, then categories).

    A column's labels do not depend on which other columns were indexed with
    it, so a second fit on a subset would only repeat a pass over the data.
    """
    numeric = {s for s in fm.slots if s not in fm.nominal}
    nums = [c for c in features if c in numeric]
    cats = [c for c in features if c in fm.label_counts]
    missing = [c for c in features if c not in numeric and c not in fm.label_counts]
    if missing:
        raise ValueError(f"not in the feature matrix: {missing}")
    return replace(
        fm,
        slots=nums + [c + INDEX_SUFFIX for c in cats],
        nominal={c + INDEX_SUFFIX: c for c in cats},
        label_counts={c: fm.label_counts[c] for c in cats},
    )


def plain_vector(slots: Sequence[str]) -> F.Column:
    """Dense vector of the slot columns, without ML attributes (all slots continuous).

    Equal to the assembled ``features`` vector slot by slot, built in one step.
    """
    return array_to_vector(F.array(*[F.col(quote_name(s)).cast("double") for s in slots]))


@contextmanager
def fit_input(train: DataFrame, rows: int) -> Iterator[DataFrame]:
    """The narrow (label, vector) frame that a fit reads several times, kept for as long as the fit takes.

    Up to ``FIT_IN_MEMORY`` rows are cached as they lie.  More are written to the shared folder in files of
    ``FIT_FILE_ROWS`` rows: MLlib holds each task's rows as objects of some hundred bytes, where the same rows take a few bytes in a
    file, so tasks dealt by bytes would hold more the better the rows compress.  Spark counts 4 MB for opening a
    file and deals 128 MB to a task (both its defaults), so no task gets more than 32 files, nothing is shuffled for it, and more
    rows give more tasks, not larger ones.
    """
    if rows > FIT_IN_MEMORY:
        yield cut_lineage(train, "points", FIT_FILE_ROWS)
        return
    held = train.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield held
    finally:
        held.unpersist()


def slot_names(df: DataFrame, col: str = "features") -> list[str]:
    """Slot names from the vector's ML attribute metadata, ordered by slot index."""
    attrs = df.schema[col].metadata.get("ml_attr", {}).get("attrs", {})
    pairs = [(a["idx"], a["name"]) for group in attrs.values() for a in group]
    return [name for _, name in sorted(pairs)]


def categorical_slots(fm: FeatureMatrix, max_categories: int = 20, col: str = "features") -> DataFrame:
    """(feature, n_distinct, is_categorical) per vector slot.

    ``is_categorical`` comes from a fitted ``VectorIndexer(maxCategories)``;
    ``n_distinct`` is an exact distinct count per slot in one aggregation over
    the long form (partial aggregation per (slot, value) first).
    """
    vi = VectorIndexer(inputCol=col, outputCol=col + INDEX_SUFFIX, maxCategories=max_categories).fit(
        fm.data.select(col)
    )
    categorical = {int(k) for k in vi.categoryMaps}
    arr = fm.data.select(vector_to_array(F.col(col)).alias("__v"))
    long = arr.select(F.posexplode("__v").alias("slot", "value"))
    counts = long.groupBy("slot").agg(F.countDistinct("value").alias("n_distinct"))
    name = F.try_element_at(F.array(*[F.lit(s) for s in fm.slots]), F.col("slot") + 1)
    flag = F.col("slot").isin(sorted(categorical)) if categorical else F.lit(False)
    return counts.select(name.alias("feature"), F.col("n_distinct"), flag.alias("is_categorical"))


def cut_positions(cuts: DataFrame) -> DataFrame:
    """(feature, cuts): the distinct thresholds of each feature in ascending order; as many as the tree has splits."""
    return cuts.groupBy("feature").agg(F.array_sort(F.collect_set("threshold")).alias("cuts"))


def interval_values(index: DataFrame, cuts: DataFrame, bucket: int = 4096) -> DataFrame:
    """(feature, interval, bucket, values): the categories between consecutive cuts of each feature, in index order.

    ``cuts`` has feature and threshold (the cuts a tree uses, or all of them).  Interval ``k`` holds the indexes above ``k`` of the feature's
    distinct cuts, so ``idx <= cuts[k]`` is the union of the intervals up to ``k``.  Every value is in
    one list only, and a list holds ``bucket`` values at most: the table is linear in the index, however many cuts there
    are, and no task gathers a feature.  Features without cuts are left out.
    """
    placed = index.join(F.broadcast(cut_positions(cuts)), "feature")  # one row a feature, one number a cut
    return (
        placed.select(
            "feature", F.size(F.filter("cuts", lambda t: t < F.col("idx"))).alias("interval"), F.floor(F.col("idx") / bucket).alias("bucket"), "idx", "value"
        )
        .groupBy("feature", "interval", "bucket")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "value"))), lambda s: s["value"]).alias("values"))
    )


def condition_values(conditions: DataFrame, intervals: DataFrame, cuts: DataFrame, key: Sequence[str]) -> DataFrame:
    """(*key, values): all categories on the side of each condition (feature, op, threshold), in index order.

    Put together from whole interval lists, so its size is that of the values it lists.
    """
    at = F.array_position("cuts", F.col("threshold")) - 1
    placed = conditions.join(F.broadcast(cut_positions(cuts)), "feature").select(*key, "feature", "op", at.alias("cut"))
    side = F.when(F.col("op") == "<=", F.col("interval") <= F.col("cut")).otherwise(F.col("interval") > F.col("cut"))
    lists = F.array_sort(F.collect_list(F.struct("interval", "bucket", "values")))
    met = placed.join(intervals, "feature").where(side).groupBy(*key).agg(lists.alias("lists"))
    return met.select(*key, F.flatten(F.transform("lists", lambda s: s["values"])).alias("values"))


def category_conditions(lookup: DataFrame, cuts: DataFrame | None = None) -> DataFrame:
    """(feature, threshold, op, value_list): both sides of every cut of each feature.

    ``value_list`` is the quoted, comma-joined list of categories on that side
    (``idx <= threshold`` or ``idx > threshold``), in index order.  ``cuts`` (feature, threshold) are the cuts to
    list, by default all between consecutive indexes; what is written grows with them.
    """
    if cuts is None:
        last = lookup.groupBy("feature").agg(F.max("idx").alias("last"))
        cuts = lookup.join(last, "feature").where("idx < last").select("feature", (F.col("idx") + 0.5).alias("threshold"))
    sides = cuts.distinct().withColumn("op", F.explode(F.array(F.lit("<="), F.lit(">"))))
    values = condition_values(sides, interval_values(lookup, cuts), cuts, ["feature", "threshold", "op"])
    return values.select("feature", "threshold", "op", F.concat(F.lit('"'), F.array_join("values", '","'), F.lit('"')).alias("value_list"))
