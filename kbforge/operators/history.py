"""Question history per session (WIN-2, WIN-3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import ellipsis

# Entries shown per session and the preview cut.
HISTORY_DEPTH = 8
PREVIEW_CHARS = 60


def recent_history(log: DataFrame, session: str, time: str, text: str,
                   depth: int = HISTORY_DEPTH) -> DataFrame:
    """WIN-2 + WIN-3: the newest ``depth`` entries per session, newest first
    (``pos`` 1..depth; entries of one time by text, descending), with the newest flagged ``is_latest``.

    ``row_number() <= depth`` is planned with a partial WindowGroupLimit, so a
    session holding a third of the log forwards at most ``depth`` rows per task.
    """
    w = Window.partitionBy(session).orderBy(F.col(time).desc(), F.col(text).desc())
    ranked = log.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= depth)
    return ranked.select(
        session, time, F.col("pos").cast("long").alias("pos"),
        (F.col("pos") == 1).alias("is_latest"),
        ellipsis(F.col(text), PREVIEW_CHARS, "if_longer").alias("preview"))


# Fixed value: previous entries are labelled with the question cut to 80 characters.
PREVIOUS_LABEL_CHARS = 80


def latest_and_previous(log: DataFrame, session: str, time: str, text: str) -> DataFrame:
    """WIN-3 over the whole history: the newest entry of each session flagged, all
    earlier ones kept.

    No window over a session: the newest time comes from a partial ``max`` per
    session joined back (AQE splits a skewed join).  Rows are not sorted; a reader
    that shows one session orders its rows by time.
    """
    newest = log.groupBy(session).agg(F.max(time).alias("_newest"))
    j = log.join(newest, session, "inner")
    return (j.select(session, time, (F.col(time) == F.col("_newest")).alias("is_latest"),
                     F.concat(F.lit("Q: "), ellipsis(F.col(text), PREVIOUS_LABEL_CHARS, "always")).alias("label")))
