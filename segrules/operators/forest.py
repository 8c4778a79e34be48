"""Random forests on many rows: MLlib's trees, grown level by level over rows that are binned once.

MLlib looks up node, statistics and features of every (row, tree) pair through objects, so a row, tree and level costs it
about a microsecond.  Here the rows are written once as blocks of small integers, and a task adds up a tree's histograms
over its blocks with numpy.  Rules are MLlib's: its candidate thresholds, its order of categories, a fresh draw of features for
every node, a bootstrap count per row and tree, its gain, its leaves and its merging of equal sibling leaves.  Every tree sees
all rows at every level; counts are drawn again from the same seeds instead of being kept, and rows walk down the levels found.

A level is one job: histograms per task and tree, summed by (tree, range of nodes), and the best split of each node
found there.  Only the splits, as many as the model has nodes, reach the driver.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence
from dataclasses import astuple, dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext, cloudpickle
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segrules.session import cut_lineage, shared_path
from segrules.sources.tables import quote_name

#: Rows of a block, the unit of which tasks get several; each is a file of its own, so that Spark deals them out evenly.
BLOCK_ROWS = 32_768
#: Histogram cells of one row of the shuffle.
PIECE_CELLS = 1 << 18
#: Bytes of the tables sent to the tasks in one pass; trees with more in all take several passes a level.
PASS_BYTES = 64 << 20
EPSILON = float(np.finfo(float).eps)  # a child with less impurity is a leaf

BLOCKS = "part int, block int, rows int, bins binary"
PARTIALS = "tree int, piece int, cells binary"
SPLITS = "tree int, node int, valid boolean, feature int, gain double, total_0 double, total_1 double, left_0 double, left_1 double, goes_left binary"

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need not have this library


@dataclass(frozen=True)
class Slots:
    """How the slots of a vector are binned: by thresholds, or, where ``values`` is not 0, by category."""

    values: list[int]
    cuts: list[list[float]]

    @property
    def bins(self) -> np.ndarray:
        return np.array([v or len(c) + 1 for v, c in zip(self.values, self.cuts)], np.int64)

    @property
    def type(self) -> type:
        """A cell holds 2 * bin + label."""
        return np.uint8 if 2 * self.bins.max() <= 256 else np.uint16


@dataclass
class Level:
    """The nodes of one tree that a pass splits: node ``i`` is column ``i``, column 0 takes the rows that ended in a leaf."""

    features: np.ndarray  # drawn features x nodes
    base: np.ndarray  # first histogram cell, likewise
    cells: int

    def pieces(self) -> list[tuple[int, int]]:
        """Ranges of nodes of about ``PIECE_CELLS`` cells."""
        ranks = self.base[0, 1:] // PIECE_CELLS
        first = [int(i) + 1 for i in np.flatnonzero(np.diff(ranks, prepend=-1))]
        return list(zip(first, [*first[1:], self.base.shape[1]]))

    def cells_of(self, nodes: tuple[int, int]) -> slice:
        return slice(int(self.base[0, nodes[0]]), int(self.base[0, nodes[1]]) if nodes[1] < self.base.shape[1] else self.cells)


@dataclass
class Growing:
    """One tree on the driver: what is known of its nodes by level (children of a level's splits in their order, left first)."""

    number: int
    counts: list[np.ndarray] = field(default_factory=list)
    impurity: list[np.ndarray] = field(default_factory=list)
    gain: list[np.ndarray] = field(default_factory=list)
    feature: list[np.ndarray] = field(default_factory=list)  # -1: leaf
    left: list[np.ndarray] = field(default_factory=list)  # a split's left child, as a place in the next level
    sides: list[list[bytes]] = field(default_factory=list)  # of the splits: for each bin whether it goes left
    open: np.ndarray | None = None  # places of the nodes that the next pass splits
    level: Level | None = None
    # by level: feature and offset of a node, the next node by offset + cell, and whether enough rows have ended in leaves to drop them
    walk: list[tuple[np.ndarray, np.ndarray, np.ndarray, bool]] = field(default_factory=list)
    walking: float = 0.0  # weight of the rows left when some were dropped last


def slot_values(df: DataFrame, col: str, slots: int) -> list[int]:
    """Number of categories by slot from the vector's ML attributes, 0 for numbers (and for a single category, as in MLlib)."""
    attrs = df.schema[col].metadata.get("ml_attr", {}).get("attrs", {})
    found = {a["idx"]: a.get("num_vals") or len(a.get("vals", ())) for a in attrs.get("nominal", [])}
    found |= {a["idx"]: 2 for a in attrs.get("binary", [])}
    return [n if (n := found.get(i, 0)) > 1 else 0 for i in range(slots)]


def _cuts(counted: Sequence[tuple[float, int]], most: int) -> list[float]:
    """Midpoints between neighbouring values, with more than ``most`` of them those next to equal shares of the rows."""
    values = sorted(counted)
    middles = [(a[0] + b[0]) / 2.0 for a, b in zip(values, values[1:])]
    if len(middles) <= most:
        return middles
    stride = sum(n for _, n in values) / (most + 1)
    cuts, before, target = [], values[0][1], stride
    for middle, (_, n) in zip(middles, values[1:]):
        after = before + n
        if abs(before - target) < abs(after - target):
            cuts.append(middle)
            target += stride
        before = after
    return cuts


def find_slots(points: DataFrame, col: str, values: list[int], rows: int, max_bins: int, seed: int) -> Slots:
    """Candidate thresholds of the numeric slots, from MLlib's sample of rows: max_bins squared and 10,000 at least."""
    numbers = [i for i, n in enumerate(values) if not n]
    share = max(max_bins**2, 10_000) / max(rows, 1)
    sample = points.sample(False, share, seed) if share < 1 else points
    found: dict[int, list[tuple[float, int]]] = {i: [] for i in numbers}
    if numbers:
        long = sample.select(F.posexplode(vector_to_array(F.col(quote_name(col)))).alias("slot", "value"))
        # values of a sample: as many as its rows, by slot
        for r in long.where(F.col("slot").isin(numbers)).groupBy("slot", "value").count().collect():
            found[r["slot"]].append((r["value"], r["count"]))
    return Slots(values, [_cuts(found[i], min(max_bins, rows) - 1) if i in found else [] for i in range(len(values))])


def binned_blocks(points: DataFrame, col: str, slots: Slots) -> DataFrame:
    """The rows as blocks in the shared folder: 2 * bin + label of each slot, row by row."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made, held, count = TaskContext.get().partitionId(), 0, [], 0

        def block() -> pa.RecordBatch:
            cells = np.concatenate(held)
            one = cells[:BLOCK_ROWS]
            held[:] = [cells[BLOCK_ROWS:]]
            return pa.RecordBatch.from_pylist([{"part": part, "block": made, "rows": len(one), "bins": one.tobytes()}], pa.schema(
                [("part", pa.int32()), ("block", pa.int32()), ("rows", pa.int32()), ("bins", pa.binary())]))

        for batch in batches:
            label = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(label), len(slots.values))
            cells = np.empty(x.shape, slots.type)
            for i, (n, cuts) in enumerate(zip(slots.values, slots.cuts)):
                place = x[:, i].astype(np.int64) if n else np.searchsorted(cuts, x[:, i])
                if n and len(place) and not 0 <= place.min() <= place.max() < n:
                    raise ValueError(f"slot {i} has a category beyond its {n}")
                cells[:, i] = 2 * place + label
            held.append(cells)
            count += len(label)
            while count >= BLOCK_ROWS:
                yield block()
                made, count = made + 1, count - BLOCK_ROWS
        if count:
            yield block()

    rows = points.select("label", vector_to_array(F.col(quote_name(col))).alias("x"))
    return cut_lineage(rows.mapInArrow(blocks, BLOCKS), "binned", 1)


class Bag:
    """How often a tree takes a row: Poisson counts with ``bootstrap``, else once with probability ``rate``."""

    def __init__(self, rate: float, bootstrap: bool) -> None:
        self.all = not bootstrap and rate >= 1
        if bootstrap:
            k = np.arange(1, 64 + int(8 * rate))
            self.below = np.cumsum(np.concatenate([[1.0], np.cumprod(rate / k)]) * np.exp(-rate))
        else:
            self.below = np.array([1.0 - rate, 1.0])
        self.below[-1] = 1.0
        # counts by the first 16 bits of a random number; where they do not decide, more bits do
        low, high = np.arange(65536) / 65536, np.arange(1, 65537) / 65536
        self.table = np.searchsorted(self.below, low, "right").astype(np.int16)
        self.table[self.table != np.searchsorted(self.below, high, "left")] = -1

    def counts(self, seed: Sequence[int], rows: int) -> np.ndarray:
        if self.all:
            return np.ones(rows, np.int16)
        rng = np.random.Generator(np.random.SFC64(np.random.SeedSequence(seed)))
        bits = rng.integers(0, 1 << 64, rows // 4 + 1, np.uint64).view(np.uint16)[:rows]
        counts = self.table.take(bits)
        open_ = np.flatnonzero(counts < 0)
        counts[open_] = np.searchsorted(self.below, (bits[open_] + rng.random(len(open_))) / 65536, "right")
        return counts


def _impurity(c0: np.ndarray, c1: np.ndarray, kind: str) -> np.ndarray:
    total = np.maximum(c0 + c1, 1.0)
    out = (c0 + c1 > 0).astype(float)
    if kind == "gini":
        for c in (c0, c1):
            out = out - (c / total) * (c / total)
        return out
    out = np.zeros(out.shape)
    for c in (c0, c1):
        out = out - np.where(c > 0, (c / total) * np.log(np.where(c > 0, c / total, 1.0)) / np.log(2.0), 0.0)
    return out


def _histograms(blocks: DataFrame, trees: dict[int, Growing], slots: int, cell: type, bag: Bag, seed: int) -> tuple[DataFrame, Broadcast]:
    """(tree, piece, cells): class counts by node, drawn feature and bin, of each task's rows and each tree; with what was sent for it."""
    sent = blocks.sparkSession.sparkContext.broadcast({t.number: (t.walk, astuple(t.level)) for t in trees.values()})

    def partials(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = [
            (r["part"], r["block"], r["rows"], np.frombuffer(r["bins"], cell)) for b in batches for r in b.to_pylist()
        ]
        for number, (walk, level) in sent.value.items() if mine else ():
            level, walk = Level(*level), [(*(a.astype(np.intp) for a in arrays), drop) for *arrays, drop in walk]
            features, base = level.features.astype(np.intp), level.base.astype(np.intp)
            found = np.zeros(level.cells)
            keys, weights, held = [], [], 0
            for i, (part, block, rows, cells) in enumerate(mine):
                counts = bag.counts([seed, number, part, block], rows)
                row = np.flatnonzero(counts != 0)
                weight, row = counts.take(row), row * slots
                node = np.ones(len(row), np.intp)
                for at, (feature, offset, below, drop) in enumerate(walk, 1):
                    node = below.take(offset.take(node) + cells.take(row + feature.take(node)))
                    if drop or at == len(walk):
                        still = np.flatnonzero(node != 0)
                        node, row, weight = node.take(still), row.take(still), weight.take(still)
                weight = weight.astype(float)
                for feature, first in zip(features, base):
                    keys.append(first.take(node) + cells.take(row + feature.take(node)))
                    weights.append(weight)
                    held += len(node)
                if held >= 4 * level.cells or i == len(mine) - 1:
                    found += np.bincount(np.concatenate(keys), np.concatenate(weights), level.cells)
                    keys, weights, held = [], [], 0
            found = found.astype(np.int32)
            pieces = level.pieces()
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([number] * len(pieces), pa.int32()), pa.array(range(len(pieces)), pa.int32()),
                    pa.array([found[level.cells_of(p)].tobytes() for p in pieces], pa.binary()),
                ],
                ["tree", "piece", "cells"],
            )

    return blocks.mapInArrow(partials, PARTIALS), sent


def best_splits(cells: np.ndarray, level: Level, nodes: tuple[int, int], slots: Slots, kind: str, least_rows: int, least_gain: float) -> dict:
    """The best split of each of a range of nodes by its class counts; ties go to the feature drawn first and the lower cut."""
    features, base = level.features[:, nodes[0]:nodes[1]], level.base[:, nodes[0]:nodes[1]] - level.base[0, nodes[0]]
    gains = np.full(features.shape, -np.inf)
    left = np.zeros((*features.shape, 2))
    sides = np.empty(features.shape, object)
    first = [cells[b:b + 2 * slots.bins[f]].reshape(-1, 2).sum(0) for f, b in zip(features[0], base[0])]
    totals = np.array(first).reshape(-1, 2)
    for slot in np.unique(features):
        bins = int(slots.bins[slot])
        if bins < 2:
            continue
        drawn, node = np.nonzero(features == slot)
        counts = cells[base[drawn, node][:, None] + np.arange(2 * bins)].reshape(-1, bins, 2)
        if slots.values[slot]:  # categories by their count of class 1, those without rows last
            order = np.argsort(np.where(counts.sum(2) > 0, counts[:, :, 1], np.inf), axis=1, kind="stable")
            counts = np.take_along_axis(counts, order[:, :, None], 1)
        else:
            order = np.broadcast_to(np.arange(bins), (len(node), bins))
        low = np.cumsum(counts, axis=1)[:, :-1]
        all_ = totals[node][:, None, :]
        high = all_ - low
        n, m, k = all_.sum(2), low.sum(2), high.sum(2)
        gain = (
            _impurity(all_[..., 0], all_[..., 1], kind)
            - m / np.maximum(n, 1.0) * _impurity(low[..., 0], low[..., 1], kind)
            - k / np.maximum(n, 1.0) * _impurity(high[..., 0], high[..., 1], kind)
        )
        gain = np.where((m < least_rows) | (k < least_rows) | (gain < least_gain), -np.inf, gain)
        at = gain.argmax(1)
        rows = np.arange(len(node))
        gains[drawn, node], left[drawn, node] = gain[rows, at], low[rows, at]
        goes = np.zeros((len(node), bins), np.uint8)
        np.put_along_axis(goes, order, (np.arange(bins) <= at[:, None]).astype(np.uint8), 1)
        for d, i, g in zip(drawn, node, goes):
            sides[d, i] = g.tobytes()
    best, i = gains.argmax(0), np.arange(features.shape[1])
    gain = gains[best, i]
    return {
        "node": np.arange(*nodes), "valid": np.isfinite(gain), "feature": np.where(gain > 0, features[best, i], -1), "gain": gain,
        "total_0": totals[:, 0], "total_1": totals[:, 1], "left_0": left[best, i, 0], "left_1": left[best, i, 1],
        "goes_left": [s if g > 0 else b"" for s, g in zip(sides[best, i], gain)],
    }


def _opened(places: np.ndarray, slots: Slots, drawn: int, rng: np.random.Generator) -> Level:
    features = np.argsort(rng.random((len(places), len(slots.values))), axis=1)[:, :drawn]
    sizes = 2 * slots.bins[features]
    ends = np.cumsum(sizes.ravel())
    base = (ends - sizes.ravel()).reshape(sizes.shape)
    none = np.zeros((drawn, 1), np.int32)
    return Level(np.hstack([none, features.T.astype(np.int32)]), np.hstack([none, base.T.astype(np.int64)]), int(ends[-1]))


def _add_level(tree: Growing, counts: np.ndarray, kind: str) -> np.ndarray:
    tree.counts.append(counts)
    tree.impurity.append(_impurity(counts[:, 0], counts[:, 1], kind))
    tree.gain.append(np.full(len(counts), -1.0))
    tree.feature.append(np.full(len(counts), -1, np.int32))
    tree.left.append(np.full(len(counts), -1, np.int64))
    tree.sides.append([])
    return tree.impurity[-1]


def _split_level(tree: Growing, found: pa.Table, slots: Slots, kind: str, levels: int) -> np.ndarray:
    """Takes in the splits of a level's open nodes; returns the places of the children that are to be split next."""
    got = {c: found.column(c).to_numpy() for c in found.column_names if c != "goes_left"}
    total, left = (np.stack([got[f"{x}_0"], got[f"{x}_1"]], 1) for x in ("total", "left"))
    if not tree.counts:
        _add_level(tree, total, kind)
    split = (got["feature"] >= 0) & (levels > 0)
    places = tree.open[split]
    tree.impurity[-1][tree.open[~got["valid"]]] = -1.0  # MLlib's mark of a node without a valid split
    tree.gain[-1][places] = got["gain"][split]
    tree.feature[-1][places] = got["feature"][split]
    tree.left[-1][places] = 2 * np.arange(len(places))
    sides = [x for x, goes in zip(found.column("goes_left").to_pylist(), split) if goes]
    tree.sides[-1] = sides
    if not len(places):
        return places
    children = np.stack([left[split], (total - left)[split]], 1).reshape(-1, 2)
    impurity = _add_level(tree, children, kind)
    going_on = np.zeros(len(children), bool) if levels == 1 else np.abs(impurity) >= EPSILON
    number = np.where(going_on, np.cumsum(going_on), 0).reshape(-1, 2)
    sink = 2 * int(slots.bins.max())  # where rows in leaves stay
    feature, offset = np.zeros(len(split) + 1, np.int32), np.zeros(len(split) + 1, np.int32)
    at = 1 + np.flatnonzero(split)
    feature[at] = got["feature"][split]
    sizes = 2 * slots.bins[feature[at]]
    offset[at] = sink + np.cumsum(sizes) - sizes
    goes = np.frombuffer(b"".join(sides), np.uint8)
    below = np.where(goes == 1, np.repeat(number[:, 0], sizes // 2), np.repeat(number[:, 1], sizes // 2))
    left_over = children[going_on].sum()
    drop = bool(left_over < 0.75 * (tree.walking or tree.counts[0].sum()))
    tree.walking = left_over if drop else tree.walking
    tree.walk.append((feature, offset, np.concatenate([np.zeros(sink, np.int32), np.repeat(below, 2).astype(np.int32)]), drop))
    return np.flatnonzero(going_on)


def _saved_nodes(tree: Growing, slots: Slots) -> dict[str, list]:
    """The tree's nodes as MLlib saves them, equal sibling leaves merged; ids by level, children after their parents."""
    label = [(c[:, 1] > c[:, 0]).astype(float) for c in tree.counts]
    inner = [f >= 0 for f in tree.feature]
    for d in range(len(inner) - 2, -1, -1):
        at = np.flatnonzero(inner[d])
        a = tree.left[d][at]
        same = ~inner[d + 1][a] & ~inner[d + 1][a + 1] & (label[d + 1][a] == label[d + 1][a + 1])
        inner[d][at[same]] = False
    out: dict[str, list] = {k: [] for k in ("id", "prediction", "impurity", "stats", "gain", "left", "right", "feature", "sides", "values")}
    kept, first = np.array([True]), 0
    for d, counts in enumerate(tree.counts):
        ids = first + np.cumsum(kept) - 1
        first += int(kept.sum())
        sides = dict(zip(np.flatnonzero(tree.feature[d] >= 0).tolist(), tree.sides[d]))
        below = np.zeros(len(tree.counts[d + 1]) if d + 1 < len(tree.counts) else 0, bool)
        child = first
        for i in np.flatnonzero(kept).tolist():
            goes_on, slot = bool(inner[d][i]), int(tree.feature[d][i])
            out["id"].append(int(ids[i]))
            out["prediction"].append(label[d][i])
            out["impurity"].append(tree.impurity[d][i])
            out["stats"].append(counts[i])
            out["gain"].append(tree.gain[d][i] if goes_on else -1.0)
            out["left"].append(child if goes_on else -1)
            out["right"].append(child + 1 if goes_on else -1)
            out["feature"].append(slot if goes_on else -1)
            if goes_on:
                goes = sides[i]
                out["sides"].append([float(b) for b, g in enumerate(goes) if g] if slots.values[slot] else [slots.cuts[slot][sum(goes) - 1]])
                out["values"].append(slots.values[slot] or -1)
                child += 2
                a = int(tree.left[d][i])
                below[a] = below[a + 1] = True
            else:
                out["sides"].append([])
                out["values"].append(-1)
        kept = below
    return out


def as_model(forest: RandomForestClassifier, trees: Sequence[Growing], slots: Slots, points: DataFrame) -> RandomForestClassificationModel:
    """The trees as MLlib's model: its saved form, with these nodes, loaded."""
    spark = points.sparkSession
    width = len(slots.values)
    two = spark.createDataFrame([(0.0, Vectors.dense([0.0] * width)), (1.0, Vectors.dense([1.0] * width))], ["label", forest.getFeaturesCol()])
    path = shared_path(spark, "grown-forest")
    forest.fit(two).write().overwrite().save(path)  # parameters and one entry a tree
    node = [(t.number, _saved_nodes(t, slots)) for t in trees]
    flat = {k: [x for _, n in node for x in n[k]] for k in node[0][1]}
    stats = np.array(flat["stats"]).reshape(-1, 2)
    lists = lambda rows: pa.array(rows, pa.list_(pa.float64()))
    split = pa.StructArray.from_arrays(
        [pa.array(flat["feature"], pa.int32()), lists(flat["sides"]), pa.array(flat["values"], pa.int32())],
        ["featureIndex", "leftCategoriesOrThreshold", "numCategories"],
    )
    data = pa.StructArray.from_arrays(
        [
            pa.array(flat["id"], pa.int32()), pa.array(flat["prediction"], pa.float64()), pa.array(flat["impurity"], pa.float64()),
            pa.ListArray.from_arrays(np.arange(0, 2 * len(stats) + 1, 2, np.int32), stats.ravel()), pa.array(stats.sum(1).astype(np.int64)),
            pa.array(flat["gain"], pa.float64()), pa.array(flat["left"], pa.int32()), pa.array(flat["right"], pa.int32()), split,
        ],
        ["id", "prediction", "impurity", "impurityStats", "rawCount", "gain", "leftChild", "rightChild", "split"],
    )
    numbers = np.repeat([t for t, _ in node], [len(n["id"]) for _, n in node]).astype(np.int32)
    table = pa.table({"treeID": pa.array(numbers), "nodeData": data})
    spark.createDataFrame(table).write.mode("overwrite").parquet(f"{path}/data")
    return RandomForestClassificationModel.load(path)


def can_grow(forest: RandomForestClassifier, values: Sequence[int], classes: int) -> bool:
    """Two classes and categories that fit the bins; the rest is left to MLlib, which also reports what it refuses."""
    return classes == 2 and max(values, default=0) <= forest.getMaxBins() and len(values) > 0


def grow_forest(forest: RandomForestClassifier, points: DataFrame, values: list[int], rows: int) -> RandomForestClassificationModel:
    """``forest`` fitted to ``points`` (label 0 or 1, vector): all its trees on all rows."""
    col, seed = forest.getFeaturesCol(), forest.getSeed() % (1 << 63)
    kind, depth = forest.getImpurity(), forest.getMaxDepth()
    limits = (kind, forest.getMinInstancesPerNode(), forest.getMinInfoGain())
    slots = find_slots(points, col, values, rows, forest.getMaxBins(), seed)
    drawn = len(values) if forest.getFeatureSubsetStrategy() == "all" else int(np.ceil(np.sqrt(len(values))))
    bag = Bag(forest.getSubsamplingRate(), forest.getBootstrap())
    blocks = binned_blocks(points, col, slots)
    trees = [Growing(i, open=np.array([0])) for i in range(forest.getNumTrees())]
    draws = [np.random.default_rng([seed, t.number]) for t in trees]
    for d in range(max(depth, 1)):  # at depth 0 the root is still counted
        for t in trees:
            t.level = _opened(t.open, slots, drawn, draws[t.number]) if len(t.open) else None
        for some in _passes([t for t in trees if t.level]):
            found = _level_splits(blocks, some, slots, bag, seed, limits)
            for number, t in some.items():
                mine = found.filter(pa.compute.equal(found["tree"], number)).sort_by("node")
                t.open = _split_level(t, mine, slots, kind, depth - d)
    return as_model(forest, trees, slots, points)


def _passes(trees: Sequence[Growing]) -> Iterator[dict[int, Growing]]:
    some, size = {}, 0
    for t in trees:
        bytes_ = sum(a.nbytes for *one, _ in t.walk for a in one) + t.level.features.nbytes + t.level.base.nbytes
        if some and size + bytes_ > PASS_BYTES:
            yield some
            some, size = {}, 0
        some[t.number], size = t, size + bytes_
    if some:
        yield some


def _level_splits(blocks: DataFrame, trees: dict[int, Growing], slots: Slots, bag: Bag, seed: int, limits: tuple) -> pa.Table:
    partials, sent = _histograms(blocks, trees, len(slots.values), slots.type, bag, seed)

    def best(key: tuple, table: pa.Table) -> pa.Table:
        number, piece = (k.as_py() for k in key)
        level = Level(*sent.value[number][1])
        nodes = level.pieces()[piece]
        cells = np.zeros(level.cells_of(nodes).stop - level.cells_of(nodes).start)
        for part in table.column("cells").to_pylist():
            cells += np.frombuffer(part, np.int32)
        found = best_splits(cells, level, nodes, slots, *limits)
        types = {"node": pa.int32(), "feature": pa.int32(), "valid": pa.bool_(), "goes_left": pa.binary()}
        columns = {c: pa.array(v, types.get(c, pa.float64())) for c, v in found.items()}
        return pa.table({"tree": pa.array([number] * len(found["node"]), pa.int32()), **columns})

    try:
        return partials.groupBy("tree", "piece").applyInArrow(best, SPLITS).toArrow()
    finally:
        sent.destroy()
