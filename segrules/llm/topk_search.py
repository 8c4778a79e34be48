"""Exact top-k search by a score-at-a-time index over descending quantised impact.

Vectors are packed into blocks.  In a block each dimension is a posting list,
cut into segments by quantised value.  For a query the segments of all
dimensions are taken in descending order of the most they can add; sums of
their least contributions bound every vector from below, and what is left
bounds it from above.  The walk stops only when the vectors that the bounds cannot rule out are
few (or the segments are used up), and those are rescored exactly.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from segrules.llm.common import pick
from segrules.session import cut_lineage

LEVELS = 16  # quantised values per dimension
RESCORE = 256  # the walk goes on while the bounds leave more vectors of a block than this
STEP = 48  # segments between two looks at the bounds


def quantised(vectors: DataFrame, scale: int = 1024) -> DataFrame:
    """vec_id, v array<bigint>: ``floor(scale * x)`` of each component.

    Vectors that are null, or hold null or non-finite components, and rows
    without an id take no part.  A vector so large that a product with one like it would not fit 64 bits
    (its length times the square of its largest component reaches 2^61) raises an error.
    """
    rows = pick(vectors, "vec_id", "embedding")
    whole = F.transform("embedding", lambda x: x.cast("double"))
    finite = F.forall(F.col("d"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    ints = F.transform("d", lambda x: F.floor(F.lit(float(scale)) * x))
    largest = F.array_max(F.transform("d", F.abs)) * F.lit(float(scale)) + 1
    too_large = F.size("d") * largest * largest >= 2.0**61
    refused = F.raise_error(F.lit("a vector's products would not fit 64 bits")).cast("array<bigint>")
    return (
        rows.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull())
        .select("vec_id", whole.alias("d"))
        .where(finite)
        .select("vec_id", F.when(too_large, refused).otherwise(ints).alias("v"))
    )


def _matrix(column: pa.Array) -> np.ndarray:
    """A list column as a matrix; shorter vectors are filled up with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(lengths), int(lengths.max(initial=0))), np.int64)
    out[np.arange(out.shape[1])[None, :] < lengths[:, None]] = flat
    return out


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All rows of a partition as one block: ids and matrix as bytes."""
    ids, mats = [], []
    for b in batches:
        if b.num_rows:
            ids.append(b.column(0).to_numpy(zero_copy_only=False).astype(np.int64))
            mats.append(_matrix(b.column(1)))
    if not ids:
        return
    width = max(m.shape[1] for m in mats)
    whole = np.concatenate([np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in mats])
    narrow = np.abs(whole).max(initial=0) < 2**31
    whole = whole.astype(np.int32) if narrow else whole
    yield pa.RecordBatch.from_arrays(
        [pa.array([np.concatenate(ids).tobytes()], pa.binary()), pa.array([whole.tobytes()], pa.binary()), pa.array([width], pa.int32())],
        ["ids", "data", "width"],
    )


class ImpactIndex:
    """Posting segments of one block of vectors (rows of ``x``)."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, levels: int = LEVELS) -> None:
        self.ids, self.x = ids, x
        dim, start, stop, low, high = [], [], [], [], []
        self.order = np.argsort(x, axis=0, kind="stable").T.copy() if x.size else np.zeros((x.shape[1], 0), np.int64)
        for d in range(x.shape[1]):
            v = x[self.order[d], d]
            least, most = int(v[0]), int(v[-1])
            width = max(1, -(-(most - least + 1) // levels))
            cuts = np.unique(np.concatenate([[0], np.searchsorted(v, least + width * np.arange(1, levels)), [len(v)]]))
            for a, b in zip(cuts[:-1], cuts[1:]):
                dim.append(d), start.append(a), stop.append(b), low.append(v[a]), high.append(v[b - 1])
        self.dim, self.start, self.stop = np.array(dim, np.int64), np.array(start, np.int64), np.array(stop, np.int64)
        self.low, self.high = np.array(low, np.int64), np.array(high, np.int64)
        self.least, self.most = (x.min(axis=0), x.max(axis=0)) if x.size else (np.zeros(0, np.int64),) * 2

    def search(self, query_id: int, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the ``k`` best by score, then smaller id, without rows that bear the query's id."""
        n, dims = self.x.shape
        q = np.concatenate([q, np.zeros(max(0, dims - len(q)), np.int64)])[:dims]
        own = np.flatnonzero(self.ids == query_id)
        # A segment adds between ``base`` (the least of its dimension) and what its ends allow.
        base = np.minimum(q * self.least, q * self.most)
        ends = np.stack([q[self.dim] * self.low, q[self.dim] * self.high]) - base[self.dim]
        surely, mostly = ends.min(axis=0), ends.max(axis=0)
        by_impact = np.argsort(-mostly, kind="stable")
        sums = np.zeros(n, np.int64)
        sums[own] = -(1 << 62)
        rest = np.zeros(dims, np.int64)  # the most that the next segment of a dimension adds
        np.maximum.at(rest, self.dim, mostly)
        queues: list[list[int]] = [[] for _ in range(dims)]
        for s in by_impact[::-1]:
            queues[self.dim[s]].append(int(mostly[s]))
        error = np.zeros(dims, np.int64)  # the most that a segment taken so far adds beyond its least
        possible = np.flatnonzero(self.ids != query_id)
        for taken, s in enumerate(by_impact, 1):
            if len(possible) <= max(k, RESCORE):
                break
            d = self.dim[s]
            sums[self.order[d, self.start[s] : self.stop[s]]] += surely[s]
            error[d] = max(error[d], mostly[s] - surely[s])
            queues[d].pop()
            rest[d] = queues[d][-1] if queues[d] else 0
            if taken % STEP == 0 or taken == len(by_impact):
                scores = sums[possible]
                kth = np.partition(scores, len(scores) - k)[len(scores) - k]
                possible = possible[scores + np.maximum(error, rest).sum() >= kth]  # the proof: the others cannot reach it
        exact = self.x[possible] @ q
        best = np.lexsort((self.ids[possible], -exact))[:k]
        return self.ids[possible[best]], exact[best]


def _unpack(data: bytes, rows: int, width: int) -> np.ndarray:
    narrow = len(data) == 4 * rows * width
    return np.frombuffer(data, np.int32 if narrow else np.int64).reshape(rows, width).astype(np.int64)


def _search(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                ids, data, width, qids, qdata, qwidth = (b.column(j)[i].as_py() for j in range(6))
                ids, qids = np.frombuffer(ids, np.int64), np.frombuffer(qids, np.int64)
                x = _unpack(data, len(ids), width)
                queries = _unpack(qdata, len(qids), qwidth)
                index = ImpactIndex(ids, x)
                found = [(qid, *index.search(int(qid), q, k)) for qid, q in zip(qids, queries)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.repeat(qids, [len(f[1]) for f in found]), pa.int64()),
                        pa.array(np.concatenate([f[1] for f in found]), pa.int64()),
                        pa.array(np.concatenate([f[2] for f in found]), pa.int64()),
                    ],
                    ["query_id", "vec_id", "score"],
                )

    return run


def _blocks(rows: DataFrame, per_block: int) -> tuple[DataFrame, int]:
    """Rows dealt evenly into blocks of about ``per_block`` and packed, one row a block."""
    n = max(1, math.ceil(rows.count() / per_block))
    packed = rows.repartition(n).mapInArrow(_pack, "ids binary, data binary, width int")
    return packed.withColumn("block", F.spark_partition_id()), n


def exact_top_k(
    vectors: DataFrame, is_query: Column, k: int = 10, scale: int = 1024, block_rows: int = 16384, query_rows: int = 1024
) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` highest integer inner products of each query
    with all other vectors, ties to the smaller vec_id (fewer than ``k`` if there are no more).

    ``vectors`` has vec_id and embedding; ``is_query`` is a condition on vec_id.

    Edge cases: see :func:`quantised` for what takes part.  Vectors of unequal
    length are compared as if filled up with zeros.  Rows that bear the query's
    own id are not its candidates; of repeated query rows the smallest vector asks;
    repeated candidates are listed as often as they occur.  Empty tables give no rows.

    Scale: vectors are dealt evenly into blocks, queries too; each pair of blocks is
    one unit of work with a bounded size, brought together by a join on both
    block numbers, and hands back ``k`` rows a query.  Nothing is broadcast by hand.
    """
    rows = cut_lineage(quantised(vectors, scale), "vectors")
    queries = rows.where(is_query).groupBy("vec_id").agg(F.min("v").alias("v"))
    x, n_x = _blocks(rows, block_rows)
    q, n_q = _blocks(queries, query_rows)
    x = cut_lineage(x, "vector_blocks").withColumn("query_block", F.explode(F.sequence(F.lit(0), F.lit(n_q - 1))))
    q = (
        cut_lineage(q, "query_blocks")
        .select(F.col("ids").alias("q_ids"), F.col("data").alias("q_data"), F.col("width").alias("q_width"), F.col("block").alias("query_block"))
        .withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_x - 1))))
    )
    pairs = x.join(q, ["block", "query_block"]).select("ids", "data", "width", "q_ids", "q_data", "q_width")
    found = pairs.mapInArrow(_search(k), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
