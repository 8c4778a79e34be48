"""Vector codes from one codebook a part, assigned with Drake-Hamerly adaptive bounds.

Vectors are cut into parts, and each part position has a codebook.  For every part of every
vector a state table keeps its ``b`` closest entries with a lower bound on the distance to each,
in ascending order, and one outer bound for all other entries.  When entries move, the bounds shrink
by what they moved; a part whose own entry is still within the next bound is settled, one that is within
the outer bound looks at its ``b`` entries only, the others look at all.  ``b`` adapts to what was needed.
Bounds are floats that are rounded to the safe side; whatever they leave open, ties too, is settled by
integer distances.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segrules.llm.common import pick
from segrules.session import cut_lineage

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
LIMIT = 2**27  # components are below it, so squared distances and their sums fit 64 bits

_STATE = "vec_id long, label string, v binary, near binary, low binary, outer binary, error long, needed int"
SAFE = np.float32(1 + 2.0**-20)  # more than a float's rounding


def whole_vectors(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, label (as text), v array<bigint>: ``floor(scale * x)`` of each component; vectors that are null or
    hold null or non-finite components are left out."""
    rows = pick(vectors, "vec_id", "label", "embedding")
    finite = F.forall("d", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    large = F.exists("d", lambda x: F.abs(x) * scale >= LIMIT - 1)
    whole = F.transform("d", lambda x: F.floor(x * F.lit(float(scale))))
    refused = F.raise_error(F.lit(f"components times {scale} have to be below 2^27")).cast("array<bigint>")
    return (
        rows.where(F.col("embedding").isNotNull())
        .select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("d"))
        .where(finite)
        .select(F.col("vec_id").cast("long"), F.col("label").cast("string"), F.when(large, refused).otherwise(whole).alias("v"))
    )


def first_codebooks(rows: DataFrame, parts: int, entries: int) -> np.ndarray:
    """(parts, entries, width) from the ``entries`` smallest vec_ids, ascending; fewer rows give fewer entries."""
    first = rows.orderBy(F.asc_nulls_last("vec_id"), "v").limit(entries).select("v").collect()
    whole = np.array([r["v"] for r in first], np.int64)
    return whole.reshape(len(first), parts, -1).transpose(1, 0, 2).copy()


def distances(v: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Squared distances of rows to entries, as integers."""
    return ((v[:, None, :] - book[None, :, :]) ** 2).sum(axis=2)


def roots(squared: np.ndarray, up: bool) -> np.ndarray:
    """Distances as floats, rounded to the safe side."""
    d = np.sqrt(squared.astype(np.float64)).astype(np.float32)
    return d * SAFE if up else d / SAFE


def look_at_all(v: np.ndarray, book: np.ndarray, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(near, low, outer, squared distance) of each row: its ``b`` closest entries, ties to the lower index."""
    d = distances(v, book)
    order = np.argsort(d, axis=1, kind="stable")
    ordered = np.take_along_axis(d, order, axis=1)
    outer = roots(ordered[:, b], up=False) if b < d.shape[1] else np.full(len(v), np.inf, np.float32)
    return order[:, :b].astype(np.uint8), roots(ordered[:, :b], up=False), outer, ordered[:, 0]


def look_again(
    v: np.ndarray, book: np.ndarray, moved: np.ndarray, near: np.ndarray, low: np.ndarray, outer: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(near, low, outer, squared distance, entries needed) after the entries ``moved`` by so much."""
    rows = np.arange(len(v))
    near, b = near.copy(), near.shape[1]
    low = (low - moved[near] * SAFE) / SAFE - np.float32(1e-6)
    outer = (outer - moved.max(initial=0) * SAFE) / SAFE - np.float32(1e-6)
    least = ((v - book[near[:, 0]]) ** 2).sum(axis=1)
    reach = roots(least, up=True)
    low[:, 0] = roots(least, up=False)
    # Bounds within reach are open: each such entry is measured, so its bound becomes exact.
    open_ = low <= reach[:, None]
    open_[:, 0] = False
    needed = 1 + open_.sum(axis=1)
    for i in range(1, b):
        at = np.flatnonzero(open_[:, i])
        if not len(at):
            continue
        d = ((v[at] - book[near[at, i]]) ** 2).sum(axis=1)
        low[at, i] = roots(d, up=False)
        better = (d < least[at]) | ((d == least[at]) & (near[at, i] < near[at, 0]))
        won = at[better]
        least[won] = d[better]
        near[won, 0], near[won, i] = near[won, i], near[won, 0].copy()
        low[won, 0], low[won, i] = low[won, i], low[won, 0].copy()
    order = np.argsort(low[:, 1:], axis=1, kind="stable") + 1
    near[:, 1:], low[:, 1:] = near[rows[:, None], order], low[rows[:, None], order]
    far = np.flatnonzero(outer <= roots(least, up=True))
    if len(far):
        near[far], low[far], outer[far], least[far] = look_at_all(v[far], book, b)
        needed[far] = b
    return near, low, outer, least, needed


def _matrix(column: pa.Array, dtype: str, *shape: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(len(column), *shape)


def _bytes(x: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in x], pa.binary())


def _assign(books: np.ndarray, before: np.ndarray | None, b: int, b_before: int):
    """State rows for the codebooks; with the ones ``before`` the rows' bounds are used, else all entries are looked at."""
    parts, _, width = books.shape
    moved = None if before is None else roots(((books - before) ** 2).sum(axis=2), up=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            v = _matrix(batch.column(2), "<i4", parts, width).astype(np.int64)
            near, low, outer = np.zeros((n, parts, b), np.uint8), np.zeros((n, parts, b), np.float32), np.zeros((n, parts), np.float32)
            error, needed = np.zeros(n, np.int64), np.ones(n, np.int64)
            if before is not None:
                old_near = _matrix(batch.column(3), "u1", parts, b_before)[:, :, :b]
                old_low = _matrix(batch.column(4), "<f4", parts, b_before)
                # entries beyond a smaller b fall under the outer bound, which is the least of theirs then
                old_outer = np.minimum(_matrix(batch.column(5), "<f4", parts), old_low[:, :, b:].min(axis=2, initial=np.inf))
            for p in range(parts):
                if before is None:
                    near[:, p], low[:, p], outer[:, p], least = look_at_all(v[:, p], books[p], b)
                else:
                    near[:, p], low[:, p], outer[:, p], least, used = look_again(
                        v[:, p], books[p], moved[p], old_near[:, p], old_low[:, p, :b], old_outer[:, p]
                    )
                    needed = np.maximum(needed, used)
                error += least
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], _bytes(near), _bytes(low), _bytes(outer), pa.array(error), pa.array(needed, pa.int32())],
                ["vec_id", "label", "v", "near", "low", "outer", "error", "needed"],
            )

    return run


def _sums(parts: int, width: int, b: int):
    """Per task: (part, entry, n, sums) of the parts assigned to each entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = np.zeros((parts, 256), np.int64), np.zeros((parts, 256, width), np.int64)
        for batch in batches:
            v = _matrix(batch.column(0), "<i4", parts, width).astype(np.int64)
            near = _matrix(batch.column(1), "u1", parts, b)
            for p in range(parts):
                np.add.at(n[p], near[:, p, 0], 1)
                np.add.at(sums[p], near[:, p, 0], v[:, p])
        part, entry = np.nonzero(n)
        if len(part):
            columns = [pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(n[part, entry]), pa.array(list(sums[part, entry]), pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["part", "entry", "n", "sums"])

    return run


def moved_codebooks(state: DataFrame, books: np.ndarray, b: int) -> np.ndarray:
    """Each entry replaced by the componentwise floor(sum / count) of its parts; unused entries stay."""
    parts, _, width = books.shape
    rows = state.select("v", "near").mapInArrow(_sums(parts, width, b), "part int, entry int, n long, sums array<long>")
    total = rows.groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(width)])
    out = books.copy()
    for r in total.collect():  # at most one row an entry
        out[r["part"], r["entry"]] = [r[f"s{i}"] // r["n"] for i in range(width)]
    return out


def compress_vectors(
    vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE
) -> DataFrame:
    """One row per kept row of ``vectors`` (vec_id, embedding, label): vec_id, code (two hex digits a part), error,
    label_error and codebooks_sha256.

    Components become integers, ``floor(scale * x)``; a vector is cut into ``parts`` equal parts.  A part's
    codebook starts as that part of the ``entries`` (256 at most) smallest vec_ids; each round assigns every part to its nearest
    entry (ties to the lower index) and moves the entries to the floor of their parts' means.  ``error`` is the
    sum of the final squared distances, ``label_error`` its sum over the label's rows.

    Edge cases: vectors that are null, or hold null or non-finite components, are dropped, and so are those that
    can't be cut evenly, and those whose length is not that of the smallest vec_id left (by value, if rows share the id); components
    of 2^27 or more after scaling raise an error.  Repeated rows count each; a null vec_id comes last; null labels
    are one label; with fewer rows than ``entries`` there are as many entries as rows.  Other columns are
    ignored; an empty table gives an empty result.

    Scale: a round reads and writes the state table (``parts * (5 * b + 4)`` bytes a vector besides
    its components) without a shuffle; tasks hand back one row an entry.  Codebooks are the only thing on the driver.
    """
    spark = vectors.sparkSession
    kept = cut_lineage(whole_vectors(vectors, scale), "vectors")
    even = kept.where((F.size("v") > 0) & (F.size("v") % parts == 0))
    head = even.orderBy(F.asc_nulls_last("vec_id"), "v").select(F.size("v")).first()
    size = head[0] if head else 0
    rows = kept.where(F.size("v") == size)
    if not size:
        return spark.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    books, before, width = first_codebooks(rows, parts, entries), None, size // parts
    b = b_before = max(1, books.shape[1] // 4)
    state = rows.mapInArrow(_packed(size), _STATE)
    for turn in range(rounds + 1):
        state = cut_lineage(state.mapInArrow(_assign(books, before, b, b_before), _STATE), "state")
        if turn == rounds:
            break
        before, books = books, moved_codebooks(state, books, b)
        b_before = b
        if turn:  # what the last round needed, down to half of the first b
            b = max(min(b, state.agg(F.max("needed")).first()[0]), max(1, books.shape[1] // 8))
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    coded = state.select("vec_id", "label", F.lower(F.hex(_first_entries(parts, b))).alias("code"), "error")
    per_label = coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "own_label")
    return coded.join(per_label, F.col("label").eqNullSafe(F.col("own_label"))).select(
        "vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256")
    )


def _first_entries(parts: int, b: int) -> F.Column:
    """The first byte of every part's ``b``."""
    return F.concat(*[F.substring("near", p * b + 1, 1) for p in range(parts)])


def _packed(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat = b.column(2).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, size).astype("<i4")
            empty = pa.nulls(b.num_rows, pa.binary())
            columns = [b.column(0), b.column(1), _bytes(flat), empty, empty, empty, pa.nulls(b.num_rows, pa.int64()), pa.nulls(b.num_rows, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "label", "v", "near", "low", "outer", "error", "needed"])

    return run
