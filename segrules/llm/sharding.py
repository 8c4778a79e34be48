"""Sharding by a permutation-filled lookup table.

Shards take turns claiming slots of a prime-sized table, each in its own
order of preference; a document's key hashes to a slot and the broadcast
table gives its shard in constant time.  Adding or removing a shard moves
few slots.
"""

from __future__ import annotations

import hashlib
from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from segrules.llm.common import pick

TABLE_SIZE = 65537  # a prime; the slot table, and so the broadcast, never has more rows


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def _hash(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def slot_table(shards: Sequence[str] | Mapping[str, int], size: int = TABLE_SIZE) -> list[str]:
    """The shard that owns each of ``size`` slots.

    A shard's order of preference is ``(offset + j * skip) mod size``, a
    permutation because ``size`` is prime.  Shards take turns in the order of
    their names; one with weight ``w`` claims ``w`` slots a turn.  Every slot
    ends up owned and, at equal weights, two shards differ by one slot at most.
    """
    weights = dict(shards) if isinstance(shards, Mapping) else {s: 1 for s in shards}
    names = sorted(weights)
    if not names or len(names) > size or not _is_prime(size):
        raise ValueError("needs at least one shard, and a prime table size of at least the number of shards")
    if any(w < 1 for w in weights.values()):
        raise ValueError("weights are positive integers")
    skip = {s: 1 + _hash("skip:" + s) % (size - 1) for s in names}
    at = {s: _hash("offset:" + s) % size for s in names}
    owner: list[str | None] = [None] * size
    free = size
    while free:
        for s in names:
            for _ in range(weights[s]):
                if not free:
                    break
                while owner[at[s]] is not None:
                    at[s] = (at[s] + skip[s]) % size
                owner[at[s]] = s
                free -= 1
    return owner  # type: ignore[return-value]


def key_slot(key: Column, size: int = TABLE_SIZE) -> Column:
    """Slot of a key: the first 15 hexadecimal digits of the md5 of its text, modulo the table size."""
    text = F.coalesce(key.cast("string"), F.lit(""))
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long") % size).cast("int")


def assign_shards(
    docs: DataFrame, shards: Sequence[str] | Mapping[str, int], size: int = TABLE_SIZE, key: str = "doc_id"
) -> DataFrame:
    """One row per row of ``docs``: the key column, slot int, shard string.

    Edge cases: a null key has the slot of the empty text; repeated rows get the
    same shard; other columns are ignored; an empty table gives an empty result.

    Scale: no shuffle.  The broadcast holds exactly ``size`` rows, whatever the
    data, so a hot source cannot unbalance it: placement depends on the key only.
    """
    spark: SparkSession = docs.sparkSession
    table = pd.DataFrame({"slot": range(size), "shard": slot_table(shards, size)}).astype({"slot": "int32"})
    slots = spark.createDataFrame(table, "slot int, shard string")
    keyed = pick(docs, key).withColumn("slot", key_slot(F.col(key), size))
    return keyed.join(F.broadcast(slots), "slot").select(key, "slot", "shard")


def write_shards(
    docs: DataFrame,
    path: str,
    shards: Sequence[str] | Mapping[str, int],
    size: int = TABLE_SIZE,
    key: str = "doc_id",
    files_per_shard: int = 4,
    rows_per_file: int = 1_000_000,
) -> None:
    """Write ``docs`` under ``path``/shard=NAME, at least ``files_per_shard`` tasks' files each, more for a shard of over
    that many times ``rows_per_file`` rows.

    Rows of a shard are dealt to its files in turn, whatever their key, so a key that holds a third of all rows is
    spread as evenly as any.  All columns are written; where ``docs`` has one called shard the folders are
    called shard_1 (or the next free number).  Repeated rows are written each, rows with a null key go
    where :func:`key_slot` puts them, and an empty table leaves a folder without files.
    """
    spark = docs.sparkSession
    taken = {c.lower() for c in docs.columns}
    folder = next(c for c in ("shard", *(f"shard_{i}" for i in range(1, len(taken) + 2))) if c not in taken)
    table = pd.DataFrame({"slot": range(size), "shard": slot_table(shards, size)}).astype({"slot": "int32"})
    slots = F.broadcast(spark.createDataFrame(table, "slot int, shard string"))
    # the row as one column: nothing in it can clash with the columns added here
    rows = docs.select(F.struct("*").alias("row")).withColumn("slot", key_slot(F.col("row").getField(key), size))
    placed = rows.withColumn("turn", F.monotonically_increasing_id()).join(slots, "slot")
    counts = placed.groupBy("shard").agg(F.count("*").alias("rows")).withColumnRenamed("shard", "of")
    files = F.greatest(F.lit(files_per_shard), F.ceil(F.col("rows") / rows_per_file))
    salted = placed.join(F.broadcast(counts), F.col("shard") == F.col("of")).withColumn("salt", F.pmod("turn", files))  # a row a shard
    salted.repartition("shard", "salt").select("row.*", F.col("shard").alias(folder)).write.mode("overwrite").partitionBy(folder).parquet(path)
