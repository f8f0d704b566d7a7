"""WIN-2 / WIN-3 as streaming state: each session keeps its newest ``depth``
entries in ``applyInPandasWithState`` (the re-aimed per-user chat history).

State per session is bounded (``depth`` entries), whatever the session's total
size.  Every micro-batch emits the updated sessions' current history (update
mode) tagged with the batch id; the sink keeps, per session, the rows of its
latest emission.
"""

from __future__ import annotations

from typing import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupStateTimeout

from ..functions.text import ellipsis
from ..operators.history import HISTORY_DEPTH, PREVIEW_CHARS
from .batches import run_available


def _newest(times: list, texts: list, depth: int) -> tuple[list, list]:
    """Newest first; entries of one time by text, nulls last, so any split into batches keeps the same ones."""
    known = [t == t and t is not None for t in times]
    order = sorted(range(len(times)), reverse=True, key=lambda i: (
        known[i], times[i] if known[i] else 0, isinstance(texts[i], str), texts[i] if isinstance(texts[i], str) else ""))[:depth]
    return [times[i] for i in order], [texts[i] for i in order]


def _latest(times: np.ndarray, texts: np.ndarray, depth: int) -> tuple[list, list]:
    """Entries not older than the ``depth``-th newest: all that a long chunk can add."""
    if len(times) > 4 * depth and times.dtype.kind == "i":       # no null among them
        newer = times >= np.partition(times, len(times) - depth)[len(times) - depth]
        times, texts = times[newer], texts[newer]
    return _newest(times.tolist(), texts.tolist(), depth)


def _update_fn(depth: int, idle_ms: int | None):
    places = np.arange(1, depth + 1)

    def update(key, pdfs: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        times, texts = map(list, state.get) if state.exists else ([], [])
        for pdf in pdfs:
            # reduce each chunk to its newest entries before merging: memory stays O(depth)
            t, x = _latest(pdf["t"].to_numpy(), pdf["text"].to_numpy(), depth)
            times, texts = _newest(times + t, texts + x, depth)
        # a time may be null; whether it stays depends on the batches so far, so it is no error
        times = [int(t) if t is not None and t == t else None for t in times]
        if idle_ms:
            state.setTimeoutDuration(idle_ms)
        state.update((times, texts))
        # one frame a session is all that is made: frames cost more than the few entries
        yield pd.DataFrame({"session": np.full(len(times), key[0]), "t": pd.array(times, "Int64"),
                            "pos": places[:len(times)], "text": texts})
    return update


def history_stream(spark: SparkSession, source_dir: str, schema: T.StructType, session: str, time: str,
                   text: str, out_path: str, checkpoint: str, depth: int = HISTORY_DEPTH,
                   max_files_per_trigger: int | None = None, idle_ms: int | None = None) -> int:
    """``idle_ms``: a session's state is dropped after that long without an entry (never if None)."""
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    src = reader.parquet(source_dir).select(F.col(session).cast("long").alias("session"),
                                            F.col(time).cast("long").alias("t"), F.col(text).alias("text"))
    out_schema = "session long, t long, pos long, text string"
    state_schema = "times array<long>, texts array<string>"
    hist = src.groupBy("session").applyInPandasWithState(
        _update_fn(depth, idle_ms), out_schema, state_schema, "update",
        GroupStateTimeout.ProcessingTimeTimeout if idle_ms else GroupStateTimeout.NoTimeout)

    def write(batch: DataFrame, epoch_id: int) -> None:
        # one folder per micro-batch, overwritten if the batch is re-run after a
        # failure (foreachBatch is at-least-once), so no emission is stored twice
        batch.write.mode("overwrite").parquet(f"{out_path}/epoch={epoch_id}")

    return run_available(hist, write, checkpoint, "update")


def latest_history(spark: SparkSession, out_path: str, session: str, time: str) -> DataFrame:
    """The sink's current history per session: rows of each session's latest emission
    (one partial max per session, joined back)."""
    rows = spark.read.parquet(out_path)
    last = rows.groupBy("session").agg(F.max("epoch").alias("_e"))
    cur = rows.join(last, (rows["session"] == last["session"]) & (rows["epoch"] == last["_e"]), "left_semi")
    return cur.select(F.col("session").alias(session), F.col("t").alias(time), "pos",
                      (F.col("pos") == 1).alias("is_latest"),
                      ellipsis(F.col("text"), PREVIEW_CHARS, "if_longer").alias("preview"))
