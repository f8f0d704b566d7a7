"""STM-1: incremental index load with Structured Streaming.

New documents arrive as files; every micro-batch embeds and appends the records
whose id has not arrived before.  The ids seen are de-duplication state of the stream
(a state store, versioned with the batches), so a batch costs the same however much is
indexed already, and a replayed one after an executor or driver loss adds
nothing twice.  Of several rows of one id the first to arrive stays, of those in one
micro-batch any one.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .batches import batch_folder, first_seen, run_available, written_elsewhere

ARRIVED = "__arrived"


def incremental_index_load(spark: SparkSession, source_dir: str, schema: T.StructType,
                           to_records: Callable[[DataFrame], DataFrame], collection_path: str,
                           checkpoint: str, max_files_per_trigger: int | None = None,
                           source_id: Column | None = None, keep_ids_for: str | None = None) -> int:
    """Run until every file present now is indexed (``availableNow``); returns the number of micro-batches.

    ``to_records`` maps source rows to collection records (must yield ``id``).
    ``source_id`` gives a source row's record id without embedding it, so rows that are
    known leave before ``to_records`` runs, as ordinary batch code on each micro-batch.
    Without it ``to_records`` runs on the stream itself, before the de-duplication.  With
    ``keep_ids_for`` (such as ``30 days``, needs ``source_id``) an id is forgotten that
    long after the file that brought it was written; otherwise never.  Records that
    loads with other checkpoints have put into the collection are left out as well.
    """
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    rows = reader.parquet(source_dir)
    if source_id is None:
        if keep_ids_for is not None:
            raise ValueError("keep_ids_for needs source_id")
        key, fresh, finish = "id", to_records(rows).dropDuplicates(["id"]), lambda batch: batch
    else:
        key = "__record_id"
        rows = rows.select("*", source_id.alias(key), F.col("_metadata.file_modification_time").alias(ARRIVED))
        fresh, finish = first_seen(rows, key, ARRIVED, keep_ids_for), lambda batch: to_records(batch.drop(key))

    def append(batch: DataFrame, epoch_id: int) -> None:
        others = written_elsewhere(spark, collection_path, checkpoint)
        if others is not None:
            known = others.select(F.col("id").alias("__known_id"))
            batch = batch.join(known, F.col(key).eqNullSafe(F.col("__known_id")), "left_anti")
        finish(batch).write.mode("overwrite").parquet(f"{collection_path}/{batch_folder(checkpoint, epoch_id)}")

    return run_available(fresh, append, checkpoint)
