"""One folder per micro-batch, so a re-run batch replaces its own rows and nothing else."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import list_names

COLUMN = "batch"


def batch_folder(checkpoint: str, epoch_id: int) -> str:
    """Folder name of a micro-batch: epochs of different checkpoints never meet."""
    return f"{COLUMN}={hashlib.sha1(checkpoint.encode()).hexdigest()[:10]}-{epoch_id:010d}"


def written_elsewhere(spark: SparkSession, path: str, checkpoint: str) -> DataFrame | None:
    """Rows of the batches that other checkpoints have written; None if there are none.

    What this checkpoint has seen is in its state store, so its own history is
    never read again.
    """
    own = batch_folder(checkpoint, 0).rpartition("-")[0]
    others = [n for n in list_names(spark, path) if n.startswith(f"{COLUMN}=") and n.rpartition("-")[0] != own]
    if not others:
        return None
    return spark.read.parquet(path).where(~F.col(COLUMN).startswith(own.partition("=")[2] + "-"))


def first_seen(stream: DataFrame, key: str, arrived: str, keep_for: str | None) -> DataFrame:
    """Rows whose ``key`` no earlier row of the stream had, by de-duplication state.

    The state holds a key a row and nothing else; a batch costs what it brings.  With
    ``keep_for`` a key is remembered that long, by the time rows ``arrived``, and
    forgotten when an earlier batch has moved the watermark beyond; else never.  A
    re-run batch reads the state before it, so it gives the same keys.
    """
    if keep_for is None:
        return stream.dropDuplicates([key]).drop(arrived)
    return stream.withWatermark(arrived, keep_for).dropDuplicatesWithinWatermark([key]).drop(arrived)


def run_available(stream: DataFrame, write, checkpoint: str, mode: str = "append") -> int:
    """Process all files present now in micro-batches; returns how many batches there were.

    The last one may bring no rows: it only moves the watermark.
    """
    done = []

    def batch(rows: DataFrame, epoch_id: int) -> None:
        write(rows, epoch_id)
        done.append(epoch_id)

    q = (stream.writeStream.outputMode(mode).foreachBatch(batch).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return len(done)
