"""STM-2: streaming ask — a stream of questions answered against a static index.

Ranking windows are not allowed on streaming frames, so each micro-batch runs
the batch ask plan (:func:`kbforge.plans.ask.ask`) inside ``foreachBatch`` and
writes its answers to a folder of its own that a re-run of the batch replaces.  A
``query_id`` is answered once: the ids seen are de-duplication state of the stream.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.ask import ask
from .batches import batch_folder, first_seen, run_available, written_elsewhere
from .index_load import ARRIVED


def streaming_ask(spark: SparkSession, source_dir: str, schema: T.StructType, index: DataFrame,
                  answers_path: str, checkpoint: str, embedder=None,
                  present: Callable[[DataFrame], DataFrame] | None = None,
                  max_files_per_trigger: int | None = None, keep_ids_for: str | None = None) -> int:
    """Answer all questions present now; returns the number of micro-batches (``keep_ids_for``: see STM-1)."""
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    rows = reader.parquet(source_dir).select("*", F.col("_metadata.file_modification_time").alias(ARRIVED))

    def answer_batch(batch: DataFrame, epoch_id: int) -> None:
        others = written_elsewhere(spark, answers_path, checkpoint)
        if others is not None:
            batch = batch.join(others.select("query_id"), "query_id", "left_anti")
        out = ask(spark, batch, index, embedder)["answers"]
        if present is not None:
            out = present(out)
        out.write.mode("overwrite").parquet(f"{answers_path}/{batch_folder(checkpoint, epoch_id)}")

    return run_available(first_seen(rows, "query_id", ARRIVED, keep_ids_for), answer_batch, checkpoint)


def request_metrics_to_table(spark: SparkSession, source_dir: str, schema: T.StructType, out_path: str,
                             checkpoint: str, window: str, watermark: str,
                             max_files_per_trigger: int | None = None, output_mode: str = "complete") -> int:
    """STM-3 request counts per (window, type).

    ``complete``: running totals, each epoch overwrites ``out_path`` (state holds
    every window; for bounded replays and dashboards).  ``append``: each window is
    written once when the watermark passes it and its state is dropped, so state
    stays bounded on an endless stream (rows later than the watermark are not counted).
    """
    from .metrics import request_counts_stream
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    counts = request_counts_stream(reader.parquet(source_dir), window=window, watermark=watermark)

    def write(batch: DataFrame, epoch_id: int) -> None:
        if output_mode == "complete":
            batch.write.mode("overwrite").parquet(out_path)
        else:   # one folder per micro-batch: a re-run batch replaces its own rows
            batch.write.mode("overwrite").parquet(f"{out_path}/epoch={epoch_id}")

    return run_available(counts, write, checkpoint, output_mode)
