"""STM-2 / RAG-4 on streams: questions joined with the log of their model attempts.

Questions and attempts arrive as two streams.  A question's attempts are those of its
request within ``timeout`` of the time it was asked.  The left outer stream-stream join
keeps questions and attempts as state only until the watermark passes that time; then
the outcome is final and is written once: ``answered`` or ``failed`` by the first
attempt that decides, else ``exhausted``, also for a question nobody attempted.
Rows that come later than ``late`` after the newest of their stream are not joined.

An open request is written when both streams have moved on by ``timeout`` and ``late``.
A log that ends is closed by a heartbeat on both streams: a row of a request of its own
with a later time (one without a request would be filtered out before the watermark).
Requests are not null.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.rag import resolve_attempts
from .batches import batch_folder, run_available


def outcomes(questions: DataFrame, attempts: DataFrame, request: Sequence[str], asked: str = "asked", at: str = "at",
             order: Sequence[str] = ("at", "attempt_id"), attempt_id: str = "attempt_id", model: str = "model",
             error: str = "error", timeout: str = "1 day", late: str = "1 hour") -> DataFrame:
    """(request, asked, outcome, model, decided_by, error, attempts); streams or tables, times are timestamps."""
    q = questions.select(*request, asked)
    a = attempts.select(*[F.col(c).alias(f"_a_{c}") for c in dict.fromkeys([*request, at, *order, attempt_id, model, error])])
    if questions.isStreaming:
        q, a = q.withWatermark(asked, late), a.withWatermark(f"_a_{at}", late)
    of = [F.col(c) == F.col(f"_a_{c}") for c in request]
    of += [F.col(f"_a_{at}") >= F.col(asked), F.col(f"_a_{at}") < F.col(asked) + F.expr(f"INTERVAL {timeout}")]
    return resolve_attempts(q.join(a, of, "left_outer"), [*request, asked], [f"_a_{c}" for c in order], f"_a_{attempt_id}",
                            f"_a_{model}", f"_a_{error}", present=F.col(f"_a_{at}").isNotNull())


def outcome_stream(spark: SparkSession, questions_dir: str, questions_schema: T.StructType, attempts_dir: str,
                   attempts_schema: T.StructType, out_path: str, checkpoint: str, request: Sequence[str],
                   max_files_per_trigger: int | None = None, **how) -> int:
    """Write the outcomes of all requests that are over; returns the number of micro-batches."""
    def read(path: str, schema: T.StructType) -> DataFrame:
        reader = spark.readStream.schema(schema)
        if max_files_per_trigger:
            reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
        return reader.parquet(path)

    def write(batch: DataFrame, epoch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out_path}/{batch_folder(checkpoint, epoch_id)}")

    both = outcomes(read(questions_dir, questions_schema), read(attempts_dir, attempts_schema), request, **how)
    return run_available(both, write, checkpoint)


__all__ = ["outcome_stream", "outcomes"]
