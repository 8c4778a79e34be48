"""Small shared helpers: exact column picking, ASCII lower case, token patterns, 64-bit mixing."""

from __future__ import annotations

import ctypes
import gc
import string
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# ASCII white space of the line and token rules.
ASCII_SPACE = " \t\n\x0b\x0c\r"


def pick(df: DataFrame, *names: str) -> DataFrame:
    """The named columns and no others, found by exact spelling.

    Operators call this first, so extra columns never clash with what an
    operator adds, whatever they are called; of several columns spelt alike
    the first counts.
    """
    columns = df.columns
    numbered = df.toDF(*[f"c{i}" for i in range(len(columns))])
    return numbered.select(*[F.col(f"c{columns.index(n)}").alias(n) for n in names])


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; other letters stay.  Pure ASCII texts take the cheaper ``lower``."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    )


def id_bucket(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus`` (null ids count as the empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % modulus


def id_bitmap(hashes: DataFrame, column: str, bits: int) -> Callable[[Column], Column]:
    """A test whether a 64-bit hash may be in ``column``: two probes into ``bits`` bits, held as one literal.

    Its size is fixed, so it can go to every task however many hashes there are.  It lets through all
    that are in the column and a few that are not: an exact join follows, and a full bitmap costs time, not rows.
    """
    probes = hashes.select(F.explode(F.array(F.col(column), F.shiftright(column, 32))).alias("p"))
    cells = probes.groupBy(F.shiftright(F.col("p").bitwiseAND(bits - 1), 6).cast("int").alias("cell")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("v")
    )
    longs = [0] * (bits // 64)
    for cell, v in cells.collect():  # at most bits / 64 rows
        longs[cell] = v
    bitmap = F.split(F.lit(",".join(map(str, longs))), ",").cast("array<bigint>")

    def bit(p: Column) -> Column:
        at = p.bitwiseAND(bits - 1)
        return F.bit_get(F.get(bitmap, F.shiftright(at, 6).cast("int")), at.bitwiseAND(63).cast("int")) == 1

    return lambda h: bit(h) & bit(F.shiftright(h, 32))


def give_back() -> None:
    """Return what this worker has freed to the system: workers are kept between tasks, with all they once held."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective avalanche mixing of unsigned 64-bit integers."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))
