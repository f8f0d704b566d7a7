"""STM-3 request metrics and EVT-1 health snapshot (batch and streaming forms)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import elapsed_seconds
from .batches import run_available

DEFAULT_WINDOW = "1 hour"
DEFAULT_WATERMARK = "1 day"


def _epoch() -> F.Column:
    # built per call: a module-level Column would need an active session at import
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")


def _event_time(df: DataFrame, ts: str) -> DataFrame:
    """Event time as an instant: the wall-clock (NTZ) value read as UTC.

    ``withWatermark`` does not accept timestamp_ntz, and a plain cast would read
    the wall clock in the session time zone (windows of a +05:30 session would
    start at :30).  Microseconds since the NTZ epoch avoid the session zone.
    """
    return df.withColumn("_et", F.timestamp_micros(F.timestamp_diff("MICROSECOND", _epoch(), F.col(ts))))


def _wall_clock(instant) -> F.Column:
    """Inverse of :func:`_event_time` rendered as text (no session zone involved)."""
    return F.date_format(F.timestamp_add("MICROSECOND", F.unix_micros(instant), _epoch()), "yyyy-MM-dd HH:mm:ss")


def request_counts(events: DataFrame, ts: str = "ts", kind: str = "event_type",
                   window: str = DEFAULT_WINDOW) -> DataFrame:
    """Batch form: requests per (time window, type)."""
    e = _event_time(events, ts)
    g = e.groupBy(F.window("_et", window).alias("w"), F.col(kind)).agg(F.count(F.lit(1)).cast("long").alias("requests"))
    return g.select(_wall_clock(F.col("w.start")).alias("window_start"), kind, "requests")


def request_counts_stream(events_stream: DataFrame, ts: str = "ts", kind: str = "event_type",
                          window: str = DEFAULT_WINDOW, watermark: str = DEFAULT_WATERMARK) -> DataFrame:
    """Streaming form: the same counts with a watermark bounding the state."""
    e = _event_time(events_stream, ts).withWatermark("_et", watermark)
    g = e.groupBy(F.window("_et", window).alias("w"), F.col(kind)).agg(F.count(F.lit(1)).cast("long").alias("requests"))
    return g.select(_wall_clock(F.col("w.start")).alias("window_start"), kind, "requests")


def health_snapshot(events: DataFrame, index: DataFrame, ts: str = "ts") -> DataFrame:
    """EVT-1: one row (status, uptime_seconds, requests_served, index_size).

    Every event counts as a served request; uptime is last minus first event
    time.  Both inputs feed one aggregation (tagged union), no join.
    """
    t_type = events.schema[ts].dataType.simpleString()
    tagged = (events.select(F.col(ts).alias("_t"), F.lit(True).alias("_req"))
              .unionByName(index.select(F.lit(None).cast(t_type).alias("_t"), F.lit(False).alias("_req"))))
    g = tagged.agg(F.min("_t").alias("first"), F.max("_t").alias("last"),
                   F.count_if("_req").cast("long").alias("requests_served"),
                   F.count_if(~F.col("_req")).cast("long").alias("index_size"))
    return g.select(F.lit("ok").alias("status"),
                    F.coalesce(elapsed_seconds(F.col("first"), F.col("last"), 2), F.lit(0.0)).alias("uptime_seconds"),
                    "requests_served", "index_size")


def health_stream(spark, source_dir: str, schema, index: DataFrame, out_path: str, checkpoint: str,
                  ts: str = "ts", max_files_per_trigger: int | None = None) -> int:
    """EVT-1 / STM-3 streaming form: running request total, first and last
    request time and uptime, refreshed every micro-batch (complete mode over a
    single global group, so state is one row).  The index size is counted once
    from the static collection."""
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    ev = reader.parquet(source_dir).select(F.col(ts).alias("_t"))
    running = ev.agg(F.min("_t").alias("first"), F.max("_t").alias("last"),
                     F.count(F.lit(1)).cast("long").alias("requests_served"))
    size = index.count()

    def write(batch: DataFrame, epoch_id: int) -> None:
        up = elapsed_seconds(F.col("first"), F.col("last"), 2)
        (batch.select(F.lit("ok").alias("status"), F.coalesce(up, F.lit(0.0)).alias("uptime_seconds"),
                      "requests_served", F.lit(size).cast("long").alias("index_size"))
         .write.mode("overwrite").parquet(out_path))

    return run_available(running, write, checkpoint, "complete")
