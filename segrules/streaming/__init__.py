"""Structured Streaming: a saved tree applied to a stream.

The reference has no streaming work of its own; scoring is the step of it that runs on one.  The stream's rows
are joined with the tree's static index and projected, so there is no state and no watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from segrules.operators.scorer import SavedTree, score_frame


def score_stream(tree: SavedTree, stream: DataFrame, path: str, checkpoint: str, unseen: str = "keep") -> DataStreamWriter:
    """A writer, to be started, that appends the scored rows of ``stream`` as Parquet to ``path``.

    With ``unseen='error'`` one new category would end the query, so the default keeps such rows (see ``score_frame``).
    ``checkpoint`` is a folder in shared storage; after a restart the query goes on where it was.
    """
    scored = score_frame(tree, stream, unseen)
    return scored.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint)


__all__ = ["score_stream"]
