"""Near-duplicate groups by a chosen-path set similarity join.

Documents with equal shingle sets are one class.  Classes walk down random
trees: a node picks a few signature positions by its path, and a class goes to one
child for each picked position, named by its minwise token there.  At the first
level the members of a node are compared with one pivot.  Nodes whose members are not yet one
group are compared exhaustively where few of them lie outside the largest group, which is cut
into slices; the others branch further, a level at a time.  Several independent trees bring the recall up.  All links are
confirmed on full shingle sets, and linked classes are merged by
distributed contraction.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segrules.llm.common import id_bitmap, mix64, pick
from segrules.session import cut_lineage

SHINGLE = 5
SIMILARITY = 75  # in hundredths
TREES = 8
SHARED = 2.25  # picked positions per level that a pair at the threshold shares on average; with fewer it dies out with depth
POSITIONS = 64  # minwise tokens that trees choose from
SKETCH = 128  # one-byte minwise values for estimates
#: Estimates below this are not verified: five standard deviations under the threshold (0.038 each).
ESTIMATE = 0.55
NODE = 1024  # members up to which a node is one task's piece
#: Members, and shingles in them, outside a node's largest colour up to which it is compared exhaustively, not branched.
WIDE, WEIGHT = 8192, 4_000_000
DEPTH = 3
ID_BITS = 2**21  # of the bitmap that thins documents before their texts are shuffled

_RNG = np.random.default_rng(20)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64)
_SPACES = list(b" \t\n\x0b\x0c\r")
_BYTE[_SPACES] = 0
_IS_WORD = np.ones(256, bool)
_IS_WORD[_SPACES] = False
_BASE = np.uint64(0x9E3779B97F4A7C15)
_PLACE = _RNG.integers(1, 2**63, SHINGLE, dtype=np.uint64) | np.uint64(1)
_MUL = _RNG.integers(1, 2**63, SKETCH, dtype=np.uint64) | np.uint64(1)
_ADD = _RNG.integers(1, 2**63, SKETCH, dtype=np.uint64)


def word_hashes(text: bytes) -> np.ndarray:
    """64-bit hash of each white-space separated word, A-Z lower-cased."""
    b = np.frombuffer(text.lower(), np.uint8)
    is_word = _IS_WORD[b]
    starts = np.flatnonzero(is_word & ~np.concatenate([[False], is_word[:-1]]))
    if not len(starts):
        return np.zeros(0, np.uint64)
    b = b[starts[0] :]
    starts = starts - starts[0]
    stops = np.append(starts[1:], len(b))
    power = np.ones(int((stops - starts).max()), np.uint64)
    power[1:] = _BASE
    power = np.multiply.accumulate(power)
    place = np.arange(len(b)) - np.repeat(starts, stops - starts)
    return mix64(np.add.reduceat(_BYTE[b] * power[place], starts))


def shingle_set(text: bytes | None) -> np.ndarray:
    """Sorted distinct hashes of the five-word shingles; a shorter text is one shingle, a wordless one none."""
    words = word_hashes(text or b"")
    m = len(words)
    if not m:
        return words
    k = min(SHINGLE, m)
    out = np.full(m - k + 1, k, np.uint64)
    for i in range(k):
        out = mix64(out * _BASE + words[i : m - k + 1 + i] * _PLACE[i])
    return np.unique(out)


def fingerprint(s: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a whole set."""
    if not len(s):
        return 0, 0
    a, b = np.bitwise_xor.reduce(mix64(s + _BASE)), mix64(s ^ _PLACE[0]).sum(dtype=np.uint64)
    return int(a.view(np.int64)), int(b.view(np.int64))


def minwise(s: np.ndarray) -> np.ndarray:
    """The least 32-bit value of the set under each of ``SKETCH`` hash functions."""
    least = np.full(SKETCH, 2**32 - 1, np.uint64)
    for a in range(0, len(s), 4096):
        part = (s[None, a : a + 4096] * _MUL[:, None] + _ADD[:, None]) >> np.uint64(32)
        np.minimum(least, part.min(axis=1), out=least)
    return least


def linked(x: np.ndarray, y: np.ndarray, similarity: int = SIMILARITY) -> bool:
    """Whether 100 * intersection >= ``similarity`` * union, on full sets."""
    few, many = sorted((len(x), len(y)))
    if 100 * few < similarity * many:
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= similarity * (few + many - both)


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        n, s1, s2, signature, sketch = [], [], [], [], []
        for text in b.column(1).to_pylist():
            s = shingle_set(text)
            f = fingerprint(s)
            least = minwise(s)
            n.append(len(s)), s1.append(f[0]), s2.append(f[1])
            signature.append(least[:POSITIONS].astype(np.uint32).tobytes())
            sketch.append((least & np.uint64(255)).astype(np.uint8).tobytes())
        yield pa.RecordBatch.from_arrays(
            [b.column(0), pa.array(n, pa.int64()), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), pa.array(signature, pa.binary()), pa.array(sketch, pa.binary())],
            ["doc_id", "n", "s1", "s2", "signature", "sketch"],
        )


def _matrix(column: pa.Array, dtype: type, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(len(column), width)


def _children(paths: np.ndarray, signature: np.ndarray, similarity: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, child) for each position that a row's path picks: ``SHARED`` * 100 / similarity of them on average."""
    place = np.arange(POSITIONS, dtype=np.uint64)
    coins = mix64(mix64(paths)[:, None] + (place + np.uint64(1))[None, :] * _BASE)
    picked = coins < np.uint64(int(2**64 * SHARED * 100 / similarity / POSITIONS))
    rows, at = np.nonzero(picked)
    return rows, mix64(coins[rows, at] ^ mix64(signature[rows, at].astype(np.uint64) + _BASE))


def _first_level(trees: int, similarity: int):
    roots = mix64(np.arange(1, trees + 1, dtype=np.uint64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False)
            signature = _matrix(b.column(1), np.uint32, POSITIONS)
            for root in roots:
                rows, child = _children(np.full(len(ids), root, np.uint64), signature, similarity)
                yield pa.RecordBatch.from_arrays([pa.array(child.view(np.int64)), pa.array(ids[rows], pa.int64()), b.column(2).take(pa.array(rows))], ["node", "cid", "n"])

    return run


def _next_level(similarity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cids = b.column(1).to_numpy(zero_copy_only=False)
            paths = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            signature = _matrix(b.column(2), np.uint32, POSITIONS)
            rows, child = _children(paths, signature, similarity)
            yield pa.RecordBatch.from_arrays([pa.array(child.view(np.int64)), pa.array(cids[rows], pa.int64()), b.column(3).take(pa.array(rows))], ["node", "cid", "n"])

    return run


def _estimated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of pairs (a, b, n_a, n_b, sketch_a, sketch_b) those that may be similar enough."""
    for b in batches:
        if b.num_rows:
            same = (_matrix(b.column(2), np.uint8, SKETCH) == _matrix(b.column(3), np.uint8, SKETCH)).mean(axis=1)
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(same >= ESTIMATE)) for c in b.columns[:2]], ["a", "b"])


def _verified(similarity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            good = [linked(shingle_set(x), shingle_set(y), similarity) for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(good, pa.bool_())) for c in b.columns[:2]], ["a", "b"])

    return run


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Runs of rows with the same first column, across batches."""
    rows = (row for b in batches for row in zip(*(c.to_pylist() for c in b.columns)))
    for _, run in groupby(rows, key=lambda r: r[0]):
        yield list(run)


class Groups:
    """Labels of items that merge as links come in."""

    def __init__(self, labels: np.ndarray) -> None:
        self.label = np.unique(labels, return_inverse=True)[1]

    def link(self, i: int, others: np.ndarray) -> list[int]:
        """Links ``i`` with ``others``; those of them, one a label, that weren't connected with it before."""
        labels, first = np.unique(self.label[others], return_index=True)
        new = labels != self.label[i]
        if new.any():
            self.label[np.isin(self.label, labels[new])] = self.label[i]
        return others[first[new]].tolist()


def _top_last(colour: np.ndarray) -> tuple[np.ndarray, int]:
    """An order of the members with those of the most frequent colour last, and how many others there are."""
    top = np.argmax(np.bincount(colour))
    order = np.argsort(colour == top, kind="stable")
    return order, int((colour != top).sum())


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (node, cid, colour, n, sketch), sorted by node, to candidate sets (family, cid): members of
    a node that are connected by pairs of unlike colour and high estimate.  A family is
    named by its members, so the same set from several nodes is one."""
    for members in _groups(batches):
        _, colour = np.unique(np.array([m[2] for m in members], np.int64), return_inverse=True)
        if colour.max() == 0:
            continue
        order, others = _top_last(colour)
        colour = colour[order]
        cids = np.array([m[1] for m in members], np.int64)[order]
        sketch = np.frombuffer(b"".join(m[4] for m in members), np.uint8).reshape(len(members), SKETCH)[order]
        near = Groups(np.arange(len(members)))
        touched = np.zeros(len(members), bool)
        for i in range(others):  # two of the top colour are never a pair
            later = np.flatnonzero(colour[i + 1 :] != colour[i]) + i + 1
            close = later[(sketch[later] == sketch[i]).mean(axis=1) >= ESTIMATE]
            if len(close):
                touched[i] = touched[close] = True
                near.link(i, close)
        at = np.flatnonzero(touched)
        at = at[np.argsort(near.label[at], kind="stable")]
        for family in np.split(cids[at], np.flatnonzero(np.diff(near.label[at])) + 1):
            if not len(family):
                continue
            ids = np.unique(family)
            name = np.uint64(len(ids))
            for v in mix64(ids.view(np.uint64) + _BASE):
                name = mix64(np.array([name ^ v]))[0]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), name, np.uint64).view(np.int64)), pa.array(ids)], ["family", "cid"])


def links_within(sets: list[np.ndarray], colour: np.ndarray, similarity: int) -> list[tuple[int, int]]:
    """Links that join unlike colours, on full sets: sizes of all intersections come from one inverted index of the family."""
    _, colour = np.unique(colour, return_inverse=True)
    order, others = _top_last(colour)
    size = np.array([len(sets[i]) for i in order], np.int64)
    owner = np.repeat(np.arange(len(order)), size)
    _, value, times = np.unique(np.concatenate([sets[i] for i in order]), return_inverse=True, return_counts=True)
    shared = times[value] > 1  # a shingle of one member meets nobody
    owner, value = owner[shared], value[shared]
    starts = np.searchsorted(owner, np.arange(len(order) + 1))
    posting = owner[np.argsort(value, kind="stable")]
    first = np.cumsum(np.where(times > 1, times, 0)) - np.where(times > 1, times, 0)
    groups, out = Groups(colour[order]), []
    for i in range(others):
        v = value[starts[i] : starts[i + 1]]
        at = np.repeat(first[v] - (np.cumsum(times[v]) - times[v]), times[v]) + np.arange(times[v].sum())
        both = np.bincount(posting[at], minlength=len(order))
        close = np.flatnonzero(100 * both >= similarity * (size + size[i] - both))
        out += [(int(order[i]), int(order[j])) for j in groups.link(i, close)]
    return out


def _compare(similarity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (family, cid, colour, text), sorted by family, to links that join unlike colours."""
        for members in _groups(batches):
            found = links_within([shingle_set(m[3]) for m in members], np.array([m[2] for m in members], np.int64), similarity)
            if found:
                a, b = ([members[x[k]][1] for x in found] for k in (0, 1))
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def connected_components(edges: DataFrame, rounds: int | None = None) -> DataFrame:
    """(v, comp) for every vertex of ``edges`` (a, b): vertices with the same ``comp`` are connected and,
    unless ``rounds`` ends the work early, connected vertices have the same.

    Each round every vertex hooks to its neighbour (or itself) of least random
    priority and the graph is contracted, so the number of vertices
    falls by a constant factor a round whatever the graph's shape.
    """
    left = cut_lineage(edges.select("a", "b").where("a != b").distinct(), "edges")
    assigned = left.select(F.col("a").alias("v")).union(left.select("b")).distinct().withColumn("comp", F.col("v"))
    turn = 0
    while turn != rounds and not left.isEmpty():
        turn += 1

        def ranked(c: str) -> F.Column:
            return F.struct(F.xxhash64(F.lit(turn), c).alias("p"), F.col(c).alias("id"))

        both = left.select(F.col("a").alias("v"), F.col("b").alias("u")).union(left.select("b", "a"))
        least = both.groupBy("v").agg(F.min(ranked("u")).alias("m"))
        hook = cut_lineage(least.select(F.col("v").alias("h"), F.least("m", ranked("v"))["id"].alias("to")), "hooks")
        assigned = assigned.join(hook, F.col("comp") == F.col("h"), "left").select("v", F.coalesce("to", "comp").alias("comp"))
        if turn % 4 == 0:
            assigned = cut_lineage(assigned, "components")
        if turn != rounds:
            moved = left.join(hook, F.col("a") == F.col("h")).select(F.col("to").alias("a"), "b")
            moved = moved.join(hook, F.col("b") == F.col("h")).select("a", F.col("to").alias("b"))
            left = cut_lineage(moved.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    return cut_lineage(assigned, "components")


def near_duplicates(docs: DataFrame, trees: int = TREES, similarity: int = SIMILARITY, node: int = NODE, depth: int = DEPTH, wide: int = WIDE) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, kept.

    Words are separated by white space, A-Z lower-cased; the set of a text is its
    distinct five-word shingles, with fewer words the whole sequence as one.
    Two sets are linked if 100 * intersection >= ``similarity`` * union.
    ``component_id`` is the smallest doc_id reachable over links, ``kept`` tells whether
    it is the row's own.

    Edge cases: a null, empty or wordless text has an empty set and is linked with nothing.
    Rows with equal sets are one class, repeated rows too, and have the same result; rows
    that share an id but not a set are judged apart.  A null doc_id is never the
    smallest unless there is no other.  Other columns are ignored; an empty table gives
    an empty result.

    Scale: copies collapse in one aggregation before any comparison.  A node hands on
    one row per member, never pairs: members are compared with the pivot, nodes of one
    colour end, large ones with at most ``wide`` members (and ``WEIGHT`` shingles) outside the largest colour are
    cut into slices, about two rows a member, the rest
    branch, and those still larger after ``depth`` levels are cut into pairs
    of blocks, so a task's piece is bounded and no member is left out.  In a piece sketches are compared
    row by row, and the intersections of full sets come from an inverted index of the piece.

    Recall: a pair at the threshold shares ``SHARED`` children of a node on average, so its line
    dies out with a bounded probability: over all trees 1e-6 at most, at each of the first ``DEPTH`` levels.
    """
    spark = docs.sparkSession
    rows = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), F.col("text").cast("binary"))
    described = cut_lineage(
        rows.mapInArrow(_describe, "doc_id long, n long, s1 long, s2 long, signature binary, sketch binary"), "described"
    )
    classes = cut_lineage(
        described.where("n > 0")
        .groupBy("n", "s1", "s2")
        .agg(F.min("doc_id").alias("rep"), F.first("signature").alias("signature"), F.first("sketch").alias("sketch"))
        .withColumn("cid", F.monotonically_increasing_id()),
        "classes",
    )
    sketches = classes.select("cid", "n", "sketch")

    # Level 1: pivots.
    kinds = "node long, cid long, n long"
    first = cut_lineage(classes.select("cid", "signature", "n").mapInArrow(_first_level(trees, similarity), kinds), "level1")
    nodes = first.groupBy("node").agg(F.count("cid").alias("size"), F.min("cid").alias("pivot")).where("size > 1")
    members = cut_lineage(first.join(nodes, "node"), "members1")
    pairs = members.where("cid != pivot").select(F.col("cid").alias("a"), F.col("pivot").alias("b")).distinct()
    links = _confirm(rows, classes, sketches, pairs, similarity)

    # Nodes that still hold several colours go on.
    colours = connected_components(links, rounds=3)
    leaves = None
    for level in range(1, depth + 1):
        coloured = members.select("node", "cid", "n").join(colours, F.col("cid") == F.col("v"), "left").select(
            "node", "cid", "n", F.coalesce("comp", "cid").alias("colour")
        )
        tallied = coloured.groupBy("node", "colour").agg(F.count("cid").alias("k"), F.sum("n").alias("w"))
        mixed = (
            tallied.groupBy("node")
            .agg(
                F.sum("k").alias("size"), F.sum("w").alias("weight"), F.count("*").alias("colours"), F.max(F.struct("k", "colour", "w")).alias("top")
            )
            .where("colours > 1")
            .select(
                "node", "size", (F.col("size") - F.col("top.k")).alias("others"), (F.col("weight") - F.col("top.w")).alias("others_weight"),
                F.col("top.w").alias("top_weight"), F.col("top.colour").alias("top"),
            )
        )
        alive = cut_lineage(coloured.join(mixed, "node"), "mixed")
        exhaustive = (F.col("others") <= wide) & (F.col("others_weight") <= WEIGHT)
        sliced = _slices(alive.where(exhaustive), node)
        leaves = sliced if leaves is None else leaves.union(sliced)
        large = alive.where(~exhaustive)
        if large.isEmpty():
            break
        if level == depth:
            leaves = leaves.union(_block_pairs(large, wide))
            break
        grown = large.select("node", "cid", "n").join(classes.select("cid", "signature"), "cid").select("node", "cid", "signature", "n")
        members = cut_lineage(grown.mapInArrow(_next_level(similarity), kinds).distinct(), "members")

    described_leaves = leaves.join(sketches, "cid").select("node", "cid", "colour", "n", "sketch")
    sorted_leaves = described_leaves.repartition("node").sortWithinPartitions("node", "cid")
    families = cut_lineage(sorted_leaves.mapInArrow(_candidates, "family long, cid long").distinct(), "families")
    texts = _texts(rows, classes, families.select("cid").distinct())
    compared = (
        families.join(texts, "cid")
        .join(colours, F.col("cid") == F.col("v"), "left")
        .select("family", "cid", F.coalesce("comp", "cid").alias("colour"), "text")
        .repartition("family")
        .sortWithinPartitions("family", "cid")
    )
    more = cut_lineage(compared.mapInArrow(_compare(similarity), "a long, b long"), "links")
    merged = connected_components(links.union(more))

    labelled = classes.join(merged, F.col("cid") == F.col("v"), "left").select(
        "n", "s1", "s2", "rep", F.coalesce("comp", "cid").alias("comp")
    )
    least = labelled.groupBy("comp").agg(F.min("rep").alias("component_id"))
    named = cut_lineage(labelled.join(least, "comp").select("n", "s1", "s2", "component_id"), "named")
    out = described.select("doc_id", "n", "s1", "s2").join(named, ["n", "s1", "s2"], "left")
    component = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select(
        "doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept")
    )


def _texts(rows: DataFrame, classes: DataFrame, wanted: DataFrame) -> DataFrame:
    """(cid, text): a text of each wanted class, from a row with its representative's id and its set."""
    reps = cut_lineage(wanted.join(classes.select("cid", "rep", "s1", "s2"), "cid"), "wanted")
    is_rep = id_bitmap(reps.select(F.xxhash64("rep").alias("h")), "h", ID_BITS)
    likely = rows.where(is_rep(F.xxhash64("doc_id")))  # else every text is shuffled for the few that are wanted
    found = likely.join(reps, likely["doc_id"].eqNullSafe(reps["rep"])).select("cid", "s1", "s2", "text")

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cids, s1, s2, texts = (c.to_pylist() for c in b.columns)
            good = [fingerprint(shingle_set(t)) == (x, y) for t, x, y in zip(texts, s1, s2)]
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(good, pa.bool_())) for c in (b.column(0), b.column(3))], ["cid", "text"])

    return cut_lineage(found.mapInArrow(own, "cid long, text binary").groupBy("cid").agg(F.first("text").alias("text")), "texts")


def _confirm(rows: DataFrame, classes: DataFrame, sketches: DataFrame, pairs: DataFrame, similarity: int) -> DataFrame:
    """Links (a, b) among ``pairs``: size bound, estimate, then full sets."""
    a = sketches.select(F.col("cid").alias("a"), F.col("n").alias("n_a"), F.col("sketch").alias("sketch_a"))
    b = sketches.select(F.col("cid").alias("b"), F.col("n").alias("n_b"), F.col("sketch").alias("sketch_b"))
    sized = pairs.join(a, "a").join(b, "b").where(100 * F.least("n_a", "n_b") >= similarity * F.greatest("n_a", "n_b"))
    likely = cut_lineage(sized.select("a", "b", "sketch_a", "sketch_b").mapInArrow(_estimated, "a long, b long"), "likely")
    texts = _texts(rows, classes, likely.select(F.col("a").alias("cid")).union(likely.select("b")).distinct())
    both = likely.join(texts.select(F.col("cid").alias("a"), F.col("text").alias("x")), "a").join(
        texts.select(F.col("cid").alias("b"), F.col("text").alias("y")), "b"
    )
    return cut_lineage(both.select("a", "b", "x", "y").mapInArrow(_verified(similarity), "a long, b long"), "links")


def _slices(mixed: DataFrame, node: int) -> DataFrame:
    """Members of nodes with a top colour and few others: the top colour is cut into slices, and each slice
    with all the others becomes a node of its own.  Every pair of unlike colour meets.  A slice is as large as the
    others, or ``node`` members and ``WEIGHT`` shingles, whichever is more, so rows at most double."""
    top_size = F.col("size") - F.col("others")
    by_size = F.ceil(top_size / F.greatest(F.lit(node), F.col("others")))
    by_weight = F.ceil(F.col("top_weight") / WEIGHT)
    sliced = mixed.withColumn("slices", F.least(F.greatest(by_size, by_weight), top_size).cast("int"))
    own = F.array(F.pmod(F.xxhash64("cid"), F.col("slices")).cast("int"))
    every = F.sequence(F.lit(0), F.col("slices") - 1)
    at = sliced.withColumn("slice", F.explode(F.when(F.col("colour") == F.col("top"), own).otherwise(every)))
    return at.select(F.xxhash64("node", "slice").alias("node"), "cid", "colour")


def _block_pairs(large: DataFrame, wide: int) -> DataFrame:
    """Members of nodes that stayed large, cut into blocks; each pair of blocks becomes a node of its own."""
    blocks = F.greatest(F.ceil(2 * F.col("size") / wide), F.ceil(2 * (F.col("top_weight") + F.col("others_weight")) / WEIGHT))
    blocks = F.greatest(F.lit(2), F.least(blocks, F.col("size"))).cast("int")
    placed = large.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
    paired = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    name = F.xxhash64("node", F.least("block", "other"), F.greatest("block", "other"))
    return paired.select(name.alias("node"), "cid", "colour")


def keep_one_each(docs: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """The rows of ``docs`` that stay, one document of each group, with the columns in ``keep``.

    Repeated rows of the document that stays all stay; it is one document.
    """
    gone = cut_lineage(near_duplicates(docs).where(~F.col("kept")).select(F.col("doc_id").alias("__gone_id")).distinct(), "gone")
    return pick(docs, *keep).join(gone, F.col("doc_id").eqNullSafe(F.col("__gone_id")), "left_anti")
