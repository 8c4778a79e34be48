"""Line dedup: drop lines that many documents share, keep each in one document.

Method: explode normalised lines, hash them, count distinct documents per
hash, drop the lines over the threshold and reassemble by position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segrules.llm.common import ASCII_SPACE, ascii_lower, pick
from segrules.session import cut_lineage


def line_key(line: Column) -> Column:
    """A line without white space at its ends, A-Z lower-cased."""
    return ascii_lower(F.btrim(line, F.lit(ASCII_SPACE)))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, the columns named in
    ``keep``, text without the dropped lines, n_lines before dropping, n_dropped.

    A line whose key (:func:`line_key`) has at least ``min_chars`` code points
    and occurs in at least ``min_docs`` distinct documents goes, except in the
    largest doc_id that holds it, where all its occurrences stay.

    Edge cases: a null or empty text is one empty line; a text that loses all
    its lines becomes the empty text and its row stays.  Repeated rows count as one
    document and get the same result.  A null doc_id counts as one document,
    smaller than any other.  An empty table gives an empty result.  Columns
    not named are ignored.

    Scale: the exploded table holds two 64-bit hashes, the id and the
    position, never the text.  Counting aggregates before it shuffles, so a line
    that fills a third of all rows costs a counter per task.  The hot keys are
    written out first: they are broadcast only if Spark's size check allows,
    and AQE splits a hot key in the shuffled join.
    """
    rows = pick(docs, "doc_id", "text", *keep)
    text_hash = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    keyed = F.transform(_lines(F.col("text")), lambda line, i: F.struct(i.alias("pos"), line_key(line).alias("key")))
    long_lines = F.filter(keyed, lambda s: F.char_length(s["key"]) >= min_chars)
    hashed = F.transform(
        long_lines,
        lambda s: F.struct(s["pos"].alias("pos"), F.xxhash64(s["key"]).alias("h1"), F.xxhash64(F.lit(7), s["key"]).alias("h2")),
    )
    exploded = rows.select("doc_id", text_hash.alias("th"), F.explode(hashed).alias("s")).select("doc_id", "th", "s.*")
    lines = cut_lineage(exploded, "lines")

    per_doc = lines.groupBy("h1", "h2", "doc_id").agg(F.lit(1).alias("one"))
    counted = per_doc.groupBy("h1", "h2").agg(F.count("one").alias("n"), F.max("doc_id").alias("keeper"))
    hot = cut_lineage(counted.where(F.col("n") >= min_docs).select("h1", "h2", "keeper"), "hot_lines")

    dropped = (
        lines.join(hot, ["h1", "h2"])
        .where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
        .groupBy("doc_id", "th")
        .agg(F.collect_set("pos").alias("drop_pos"))
        .select(F.col("doc_id").alias("__drop_id"), F.col("th").alias("__drop_th"), F.col("drop_pos").alias("__drop_pos"))
    )
    joined = rows.withColumn("__th", text_hash).join(
        dropped, F.col("doc_id").eqNullSafe(F.col("__drop_id")) & (F.col("__th") == F.col("__drop_th")), "left"
    )
    lines_of = _lines(F.col("text"))
    kept = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), F.col("__drop_pos"))
    with_lines = joined.withColumn("__lines", lines_of)
    text = F.when(F.col("__drop_pos").isNull(), F.coalesce("text", F.lit(""))).otherwise(
        F.concat_ws("\n", F.transform(kept, lambda i: F.get("__lines", i)))
    )
    return with_lines.select(
        "doc_id",
        *keep,
        text.alias("text"),
        F.size("__lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("__drop_pos").cast("long"), F.lit(0)).alias("n_dropped"),
    )
