"""Benchmark decontamination by a prefix-filtered set join, in DataFrame operations only.

Each benchmark item is cut into windows of ``window`` consecutive words
(an item of fewer words is one window).  A window is a set of word shingles
that a document must contain whole, so one shingle is a sufficient prefix:
the rarest in the global order.  Document positions whose shingle is in that
prefix index become candidates; length and positional bounds and a word by
word comparison of the window decide.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from segrules.llm.common import ascii_lower, id_bitmap, pick
from segrules.session import cut_lineage

# What separates words once A-Z are lower-cased.
WORD_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), WORD_BREAK, -1), lambda w: w != "")


def _shingle(ws: Column, start: Column, k: int) -> Column:
    """64-bit hash of the ``k`` words from 0-based ``start``."""
    return F.xxhash64(F.lit(k), *[F.get(ws, start + j) for j in range(k)])


def _starts(n: Column, k: int) -> Column:
    """0 .. n - k, empty if there is none."""
    return F.when(n >= k, F.sequence(F.lit(0), n - k)).otherwise(F.array().cast("array<int>"))


def benchmark_windows(benchmark: DataFrame, window: int = 13, shingle: int = 3) -> tuple[DataFrame, DataFrame]:
    """(windows, items): distinct windows with their prefix shingle, and the items that hold each.

    windows: win_id, win array<string>, k, h (prefix shingle), off (its place in the window).
    items: win_id, item_id string.  The rarity order counts the items that hold
    a shingle; ties go by hash, then by place.
    """
    items = pick(benchmark, "item_id", "text").select(
        F.col("item_id").cast("string").alias("item_id"), words(F.col("text")).alias("ws")
    )
    n = F.size("ws")
    wins = F.when(n >= window, F.transform(_starts(n, window), lambda i: F.slice("ws", i + 1, window))).otherwise(
        F.array(F.col("ws"))
    )
    placed = items.where(n > 0).select("item_id", F.explode(F.array_distinct(wins)).alias("win"))
    distinct = placed.groupBy("win").agg(F.collect_set("item_id").alias("item_ids"))
    table = cut_lineage(distinct.withColumn("win_id", F.monotonically_increasing_id()), "windows")

    def hashes(k: int) -> Column:
        return F.transform(
            _starts(F.size("win"), k), lambda i: F.struct(_shingle(F.col("win"), i, k).alias("h"), i.alias("off"))
        )

    k = F.least(F.size("win"), F.lit(shingle))
    by_k = F.coalesce(*[F.when(k == j, hashes(j)) for j in range(1, shingle + 1)])
    shingles = table.select("win_id", F.size("item_ids").alias("n_items"), k.alias("k"), F.explode(by_k).alias("s")).select(
        "win_id", "n_items", "k", "s.h", "s.off"
    )
    rarity = shingles.groupBy("h").agg(F.sum("n_items").alias("freq"))
    prefix = (
        shingles.join(rarity, "h")
        .groupBy("win_id", "k")
        .agg(F.min(F.struct("freq", "h", "off")).alias("p"))
        .select("win_id", "k", "p.h", "p.off")
    )
    windows = cut_lineage(prefix.join(table.select("win_id", "win"), "win_id"), "window_index")
    return windows, table.select("win_id", F.explode("item_ids").alias("item_id"))


def _prefix_test(windows: DataFrame) -> Callable[[Column], Column]:
    """Whether a shingle may be a prefix; between 2^16 and 2^22 bits whatever the benchmark's size."""
    n = windows.agg(F.approx_count_distinct("h")).first()[0]
    return id_bitmap(windows, "h", 2 ** min(22, max(16, math.ceil(math.log2(max(1, n) * 128)))))


def find_windows(docs: DataFrame, benchmark: DataFrame, window: int = 13, shingle: int = 3) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(texts, matches, items).

    texts: row_id, doc_id, n_words for each row of ``docs``.  matches: row_id,
    start, size, win_id of every window occurrence.  items: win_id, item_id.
    """
    windows, items = benchmark_windows(benchmark, window, shingle)
    ks = [r[0] for r in windows.select("k").distinct().collect()]  # at most ``shingle`` values
    in_bitmap = _prefix_test(windows)

    def hits(k: int) -> Column:
        found = F.filter(_starts(F.size("ws"), k), lambda i: in_bitmap(_shingle(F.col("ws"), i, k)))
        return F.transform(
            found,
            lambda i: F.struct(
                i.alias("pos"),
                _shingle(F.col("ws"), i, k).alias("h"),
                F.greatest(i - (window - 1), F.lit(0)).alias("from"),
                F.slice("ws", F.greatest(i - (window - 2), F.lit(1)), 2 * window).alias("near"),
            ),
        )

    none = F.array().cast("array<struct<pos:int,h:bigint,from:int,near:array<string>>>")
    rows = pick(docs, "doc_id", "text").select("doc_id", words(F.col("text")).alias("ws"))
    scanned = cut_lineage(
        rows.select(
            F.monotonically_increasing_id().alias("row_id"),
            "doc_id",
            F.size("ws").cast("long").alias("n_words"),
            F.concat(none, *[hits(k) for k in sorted(ks)]).alias("hits"),
        ),
        "shingle_hits",
    )
    found = scanned.where(F.size("hits") > 0).select("row_id", "n_words", F.explode("hits").alias("s")).select(
        "row_id", "n_words", "s.*"
    )
    start = F.col("pos") - F.col("off")
    size = F.size("win")
    matches = (
        found.join(windows, "h")
        .where((start >= 0) & (start + size <= F.col("n_words")))  # positional and length bounds
        .where(F.slice("near", start - F.col("from") + 1, size) == F.col("win"))
        .select("row_id", start.alias("start"), size.alias("size"), "win_id")
    )
    return scanned.select("row_id", "doc_id", "n_words"), cut_lineage(matches, "window_matches"), items


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 13, shingle: int = 3, share: int = 20) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text) against ``benchmark`` (item_id, text):
    doc_id, n_words, n_hit (words inside any window occurrence), item_ids (sorted
    array of the items with an occurring window), contaminated (n_hit > 0 and
    ``share`` * n_hit >= n_words).

    Words are maximal runs of digits, letters and non-ASCII characters, A-Z lower-cased.

    Edge cases: a null or wordless text has no words and no hits; an item without
    words has no window; a null item_id marks its words but names no item.  Repeated
    documents are judged row by row, repeated items count once.  Empty tables give
    no hits or no rows.  Other columns are ignored.

    Scale: one pass over the texts, which are never shuffled.  A fixed-size bitmap keeps the
    positions whose shingle may be a prefix; only those are exploded and joined.
    The windows are broadcast only if Spark's size check allows; beyond that the
    join shuffles and AQE splits hot shingles.
    """
    texts, matches, items = find_windows(docs, benchmark, window, shingle)
    before = Window.partitionBy("row_id").orderBy("start", "size").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("start") + F.col("size")
    spans = matches.select("row_id", "start", "size").distinct()
    covered = (
        spans.withColumn("reached", F.coalesce(F.max(end).over(before), F.lit(0)))
        .groupBy("row_id")
        .agg(F.sum(F.greatest(end - F.greatest("start", "reached"), F.lit(0))).cast("long").alias("n_hit"))
    )
    named = (
        matches.select("row_id", "win_id")
        .distinct()
        .join(items, "win_id")
        .groupBy("row_id")
        .agg(F.sort_array(F.collect_set("item_id")).alias("item_ids"))
    )
    out = texts.join(covered.join(named, "row_id", "left"), "row_id", "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return out.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"),
        ((n_hit > 0) & (share * n_hit >= F.col("n_words"))).alias("contaminated"),
        "row_id",
    ).drop("row_id")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, keep: tuple[str, ...], window: int = 13, shingle: int = 3, share: int = 20) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with the columns in ``keep`` (doc_id and text among them).

    A document is dropped by id: rows of one id share its verdict if any of them is contaminated.
    Null ids are kept apart by the null-safe join.
    """
    bad = contamination(docs, benchmark, window, shingle, share).where("contaminated").select(F.col("doc_id").alias("__bad_id")).distinct()
    bad = cut_lineage(bad, "contaminated_ids")
    return pick(docs, *keep).join(bad, F.col("doc_id").eqNullSafe(F.col("__bad_id")), "left_anti")
