"""EVL-3 / STM-3: latency quantiles as mergeable sketches, beside the exact path.

A KLL sketch of a few kilobytes stands for any number of values.  Sketches of one
group and time window are made where the rows are (partial aggregation: a group with
a third of all rows is in no single task), stored as a column, and merged later: over
windows, over batches, over days.  A quantile read from a sketch of size ``k`` has a
rank that is off by about ``2.3 / k ** 0.9`` of the number of values at most
(:func:`rank_error`; 99 in 100 cases); :func:`.evaluate.latency_spread` is exact.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..streaming.batches import batch_folder, run_available

SIZE = 200                  # the sketch parameter k


def rank_error(k: int = SIZE) -> float:
    """Share of the values by which the rank of a quantile may be off, both sides together."""
    return 2.446 / k ** 0.9433 + 0.005


def sketch(rows: DataFrame, group: Sequence[str], value: str, k: int = SIZE) -> DataFrame:
    """(group, values, least, most, sketch): one row per group; null values are left out."""
    v = F.col(value).cast("double")
    return rows.where(v.isNotNull()).groupBy(*group).agg(
        F.count(F.lit(1)).cast("long").alias("values"), F.min(v).alias("least"), F.max(v).alias("most"),
        F.kll_sketch_agg_double(v, k).alias("sketch"))


def merge(sketches: DataFrame, group: Sequence[str], k: int = SIZE) -> DataFrame:
    """The same for coarser groups, from sketches alone."""
    return sketches.groupBy(*group).agg(
        F.sum("values").cast("long").alias("values"), F.min("least").alias("least"), F.max("most").alias("most"),
        F.kll_merge_agg_double("sketch", k).alias("sketch"))


def quantiles(sketches: DataFrame, group: Sequence[str], at: Sequence[float] = (0.5, 0.9)) -> DataFrame:
    """(group, values, least, most, q50, q90, ...)."""
    return sketches.select(*group, "values", "least", "most", *[
        F.kll_sketch_get_quantile_double("sketch", F.lit(float(q))).alias(f"q{round(100 * q)}") for q in at])


def sketch_stream(spark: SparkSession, source_dir: str, schema: T.StructType, out_path: str, checkpoint: str,
                  group: Sequence[str], value: str, ts: str, window: str = "1 hour", k: int = SIZE,
                  max_files_per_trigger: int | None = None) -> int:
    """Sketch every micro-batch by group and time window into a folder of its own; returns the number of batches.

    No state is kept and no earlier output is read: late rows give further sketches of
    their window, which :func:`merge` adds to the ones there.  A batch that is run again
    replaces its folder.
    """
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)

    def write(batch: DataFrame, epoch_id: int) -> None:
        start = F.date_format(F.window(F.col(ts).cast("timestamp"), window)["start"], "yyyy-MM-dd HH:mm:ss")
        (sketch(batch.withColumn("window_start", start), [*group, "window_start"], value, k)
         .write.mode("overwrite").parquet(f"{out_path}/{batch_folder(checkpoint, epoch_id)}"))

    return run_available(reader.parquet(source_dir), write, checkpoint)


__all__ = ["merge", "quantiles", "rank_error", "sketch", "sketch_stream"]
