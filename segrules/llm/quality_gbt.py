"""Quality classifier: histogram gradient-boosted trees over document statistics.

The trees are grown on the driver from a bounded sample of labelled rows and
flattened into arrays; scoring walks all trees of a batch with numpy.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segrules.llm.common import id_bucket, pick

#: Documented bound on the labelled rows that the classifier is fitted on.
FIT_ROWS = 20_000
THRESHOLD = 0.7

FEATURES = (
    "log_bytes",
    "log_words",
    "mean_word",
    "upper",
    "digit",
    "punctuation",
    "symbol",
    "bar",
    "exclamation",
    "non_ascii",
    "newline",
    "distinct_words",
    "top_word",
    "repeated_next",
    "distinct_pairs",
    "distinct_lines",
    "word_end_symbol",
    "byte_entropy",
    "longest_word",
    "longest_run",
)

_BYTES = np.arange(256)
_UPPER = (_BYTES >= 65) & (_BYTES <= 90)
_DIGIT = (_BYTES >= 48) & (_BYTES <= 57)
_PUNCT = np.isin(_BYTES, list(b".,;:?'\"()-"))
_SYMBOL = np.isin(_BYTES, list(b"#$%&*+/<=>@[\\]^_`{}~"))
_SYMBOL_ENDS = frozenset(b"#$%&*+/<=>@[\\]^_`{}~!|")


def document_statistics(text: bytes) -> list[float]:
    """The numbers in :data:`FEATURES` of one whole UTF-8 text; an empty text gives zeros."""
    n = len(text)
    if not n:
        return [0.0] * len(FEATURES)
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    words = text.split()
    m = len(words)
    lines = [x for x in text.split(b"\n") if x.strip()]
    tally = Counter(words)
    pairs = len(set(zip(words, words[1:])))
    same = list(map(eq, words, words[1:]))
    run = longest = 0
    if any(same):
        for s in same:
            run = run + 1 if s else 0
            longest = max(longest, run)
    p = counts[counts > 0] / n
    w = max(1, m)
    return [
        np.log1p(n),
        np.log1p(m),
        sum(map(len, words)) / w,
        counts[_UPPER].sum() / n,
        counts[_DIGIT].sum() / n,
        counts[_PUNCT].sum() / n,
        counts[_SYMBOL].sum() / n,
        counts[124] / n,
        counts[33] / n,
        counts[128:].sum() / n,
        counts[10] / n,
        len(tally) / w,
        max(tally.values(), default=0) / w,
        sum(same) / w,
        pairs / max(1, m - 1),
        len(set(lines)) / max(1, len(lines)),
        sum(x[-1] in _SYMBOL_ENDS for x in words) / w,
        float(-(p * np.log2(p)).sum()),
        np.log1p(max(map(len, words), default=0)),
        np.log1p(longest),
    ]


@dataclass(frozen=True)
class FlatTrees:
    """Trees of one depth as arrays: node ``i`` has children ``2i+1`` and ``2i+2``."""

    feature: np.ndarray  # trees x (2^depth - 1), int
    cut: np.ndarray  # same shape; a row goes right if its value is above the cut
    leaf: np.ndarray  # trees x 2^depth
    start: float  # log odds without any tree

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row of ``x``."""
        total = np.full(len(x), self.start)
        inner = self.feature.shape[1]
        rows = np.arange(len(x))
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf):
            node = np.zeros(len(x), np.int64)
            while inner and node[0:1].size and node[0] < inner:
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            total += leaf[node - inner]
        return 1.0 / (1.0 + np.exp(-total))


def grow_trees(
    x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, bins: int = 64, rate: float = 0.15, l2: float = 1.0, min_rows: float = 5.0
) -> FlatTrees:
    """Boosted trees for the logistic loss, each level split on per-bin sums of gradients.

    Without rows, or with one label only, there are no trees and the score is
    the smoothed share of label 1.
    """
    share = (y.sum() + 0.5) / (len(y) + 1.0)
    start = float(np.log(share / (1 - share)))
    inner = 2**depth - 1
    if len(y) == 0 or y.min() == y.max():
        return FlatTrees(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)), start)
    n, f = x.shape
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(f)]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)])
    total = np.full(n, start)
    all_feature, all_cut, all_leaf = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-total))
        g, h = y - p, p * (1 - p)
        node = np.zeros(n, np.int64)
        feature, cut = np.zeros(inner, np.int64), np.full(inner, np.inf)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            at = node - first
            best_gain, best = np.full(width, 1e-9), [None] * width
            for j in range(f):
                key = at * bins + binned[j]
                gs = np.bincount(key, g, width * bins).reshape(width, bins).cumsum(axis=1)
                hs = np.bincount(key, h, width * bins).reshape(width, bins).cumsum(axis=1)
                cs = np.bincount(key, minlength=width * bins).reshape(width, bins).cumsum(axis=1)
                ga, ha, ca = gs[:, -1:], hs[:, -1:], cs[:, -1:]
                gain = gs**2 / (hs + l2) + (ga - gs) ** 2 / (ha - hs + l2) - ga**2 / (ha + l2)
                gain[(cs < min_rows) | (ca - cs < min_rows)] = 0
                b = gain.argmax(axis=1)
                for i in np.flatnonzero(gain[np.arange(width), b] > best_gain):
                    best_gain[i], best[i] = gain[i, b[i]], (j, b[i])
            goes_right = np.zeros(n, bool)
            for i, split in enumerate(best):
                if split is not None:
                    j, b = split
                    feature[first + i], cut[first + i] = j, cuts[j][b]
                    goes_right |= (at == i) & (binned[j] > b)
            node = 2 * node + 1 + goes_right
        at = node - inner
        leaf = rate * np.bincount(at, g, inner + 1) / (np.bincount(at, h, inner + 1) + l2)
        total += leaf[at]
        all_feature.append(feature), all_cut.append(cut), all_leaf.append(leaf)
    return FlatTrees(np.array(all_feature), np.array(all_cut), np.array(all_leaf), start)


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, label, text) to (id, label, statistics)."""
    for b in batches:
        stats = [document_statistics(t or b"") for t in b.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(stats, pa.list_(pa.float64()))], ["doc_id", "y", "x"])


def is_held_out(doc_id: Column) -> Column:
    """Rows that the classifier never learns from: crc32 of the id as text, modulo 4, is 2."""
    return id_bucket(doc_id, 4) == 2


def fit_quality(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> FlatTrees:
    """Fit on at most ``fit_rows`` labelled rows outside the held-out fold.

    The rows with the smallest hash of their id are taken, a sample that does
    not depend on order, language or source.  A document labelled both ways
    counts as 1 if at least half of its labels are; null labels are ignored.
    """
    known = (
        pick(labels, "doc_id", "quality")
        .where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~is_held_out(F.col("doc_id")))
        .groupBy(F.col("doc_id").alias("label_id"))
        .agg(F.avg("quality").alias("y"))
        .orderBy(F.xxhash64("label_id"), "label_id")
        .limit(fit_rows)
    )
    # At most ``fit_rows`` rows of two numbers: the bound that allows the broadcast and the collect below.
    texts = pick(docs, "doc_id", "text").join(F.broadcast(known), F.col("doc_id") == F.col("label_id"))
    one_each = texts.groupBy("doc_id").agg(F.min("y").alias("y"), F.min("text").alias("text"))
    rows = one_each.select("doc_id", "y", F.col("text").cast("binary")).mapInArrow(_statistics, "doc_id long, y double, x array<double>")
    got = sorted((r["doc_id"], r["y"], r["x"]) for r in rows.collect())
    x = np.array([r[2] for r in got]).reshape(len(got), len(FEATURES))
    return grow_trees(x, np.array([float(r[1] >= 0.5) for r in got]))


def score_quality(docs: DataFrame, model: FlatTrees, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per row of ``docs``: the columns in ``keep`` and score double, the probability of label 1.

    Edge cases: a null text counts as empty, and an empty text has a score of
    its own (statistics of zero); ids may be null or repeated; other columns are
    ignored; an empty table gives an empty result.

    Scale: one scan without a shuffle; statistics and tree walk run on Arrow
    batches of whole texts.  Language, source and ids are not inputs.
    """
    rows = pick(docs, *dict.fromkeys(("text", *keep))).withColumn("__bytes", F.col("text").cast("binary")).select("__bytes", *keep)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[1:]) + ", score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            stats = np.array([document_statistics(t or b"") for t in b.column(0).to_pylist()]).reshape(b.num_rows, len(FEATURES))
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(model.scores(stats), pa.float64())], [*b.schema.names[1:], "score"])

    return rows.mapInArrow(run, schema)


def reject_low_quality(docs: DataFrame, labels: DataFrame, keep: tuple[str, ...], threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose score reaches ``threshold``, with the columns in ``keep``."""
    return score_quality(docs, fit_quality(docs, labels), keep).where(F.col("score") >= threshold).select(*keep)
