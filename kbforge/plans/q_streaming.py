"""Registered streaming queries (STM-1, STM-2, STM-3) and the health snapshot (EVT-1).

The streaming forms replay a shared table as a file stream: Spark writes the
table into several files under the session's checkpoint folder, a
Structured Streaming query consumes them with ``availableNow`` (several
micro-batches), and the query returns the sink table it produced.  Their oracle
is the batch SQL of the same operator.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import DEFAULT_DIM, HashingEmbedder
from ..session import list_names, run_folder
from ..streaming.ask_stream import request_metrics_to_table, streaming_ask
from ..streaming.index_load import incremental_index_load
from ..streaming.metrics import DEFAULT_WATERMARK, DEFAULT_WINDOW, health_snapshot, health_stream, request_counts
from . import adapters as A
from . import sqltext as S
from .q_eval import RAG4_SQL, attempt_log
from .flagship import SQL_RAG_ANSWERS, _answers_out, conversation_questions, curated_pairs
from .index import qa_records
from .registry import register

# A replayed table arrives in so many files, two a micro-batch, whatever its size.
REPLAY_FILES = 8
FILES_PER_TRIGGER = 2


def _as_file_stream(df: DataFrame, path: str) -> None:
    """Deal the rows to ``REPLAY_FILES`` files by a hash of all their columns."""
    name = "__replay_file"
    (df.withColumn(name, F.pmod(F.xxhash64(*df.columns), F.lit(REPLAY_FILES)))
     .repartitionByRange(REPLAY_FILES, name).drop(name).write.mode("overwrite").parquet(path))


def _several(batches: int) -> None:
    """The replay must have gone through state and several batches, or it shows nothing."""
    if batches < REPLAY_FILES // FILES_PER_TRIGGER // 2:
        raise RuntimeError(f"the stream ran in {batches} micro-batches")


SQL_COUNTS = """
SELECT strftime(time_bucket(INTERVAL 1 hour, ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type,
       CAST(count(*) AS BIGINT) AS requests
FROM events GROUP BY ALL"""


@register("stm3_request_counts", SQL_COUNTS)
def stm3_batch(spark: SparkSession, sf: str) -> DataFrame:
    return request_counts(A.table(spark, sf, "events"), window=DEFAULT_WINDOW)


@register("stm3_request_counts_stream", SQL_COUNTS)
def stm3_stream(spark: SparkSession, sf: str) -> DataFrame:
    run = run_folder(spark, "metrics")
    ev = A.table(spark, sf, "events")
    _as_file_stream(ev, f"{run}/in")
    _several(request_metrics_to_table(spark, f"{run}/in", ev.schema, f"{run}/out", f"{run}/ckpt",
                                      DEFAULT_WINDOW, DEFAULT_WATERMARK, max_files_per_trigger=FILES_PER_TRIGGER))
    return spark.read.parquet(f"{run}/out")


SQL_HEALTH = """
SELECT 'ok' AS status, CAST((epoch_us(max(ts)) - epoch_us(min(ts)) + 5000) // 10000 AS BIGINT) / 100.0 AS uptime_seconds,
       CAST(count(*) AS BIGINT) AS requests_served, (SELECT CAST(count(*) AS BIGINT) FROM embeddings) AS index_size
FROM events"""


@register("evt1_health_snapshot_stream", SQL_HEALTH)
def evt1_stream(spark: SparkSession, sf: str) -> DataFrame:
    """Running totals over the event stream; the last epoch equals the batch snapshot."""
    run = run_folder(spark, "health")
    ev = A.table(spark, sf, "events")
    _as_file_stream(ev, f"{run}/in")
    _several(health_stream(spark, f"{run}/in", ev.schema, A.table(spark, sf, "embeddings"), f"{run}/out",
                           f"{run}/ckpt", max_files_per_trigger=FILES_PER_TRIGGER))
    return spark.read.parquet(f"{run}/out")


@register("evt1_health_snapshot", SQL_HEALTH)
def evt1(spark: SparkSession, sf: str) -> DataFrame:
    return health_snapshot(A.table(spark, sf, "events"), A.table(spark, sf, "embeddings"))


@register("stm1_incremental_index", f"""
WITH {S.sparse_vectors('d', 'documents', 'doc_id', 'text', DEFAULT_DIM)}
SELECT s.doc_id AS key, CAST(count(v.b) AS BIGINT) AS n_buckets
FROM documents s LEFT JOIN d_vec v ON v.key = s.doc_id GROUP BY s.doc_id""")
def stm1(spark: SparkSession, sf: str) -> DataFrame:
    """Documents arrive in several files; the collection ends with each id once."""
    run = run_folder(spark, "index")
    docs = A.table(spark, sf, "documents").select("doc_id", "text")
    _as_file_stream(docs, f"{run}/in")
    emb = HashingEmbedder(DEFAULT_DIM)

    def to_records(b: DataFrame) -> DataFrame:
        r = b.select(F.col("doc_id").alias("key"), F.col("doc_id").cast("string").alias("id"),
                     F.col("text").alias("document"))
        return emb.embed(r, "document", "embedding").withColumn(
            "meta", F.struct(F.lit(None).cast("string").alias("title"), F.lit(None).cast("int").alias("question_score"),
                             F.lit(None).cast("int").alias("answer_score")))

    _several(incremental_index_load(spark, f"{run}/in", docs.schema, to_records, f"{run}/collection",
                                    f"{run}/ckpt", max_files_per_trigger=FILES_PER_TRIGGER,
                                    source_id=F.col("doc_id").cast("string")))
    col = spark.read.parquet(f"{run}/collection")
    return col.select("key", F.size(F.filter("embedding", lambda x: x > 0)).cast("long").alias("n_buckets"))


@register("stm2_streaming_ask", SQL_RAG_ANSWERS)
def stm2(spark: SparkSession, sf: str) -> DataFrame:
    """User turns arrive as a stream and are answered against the curated index."""
    run = run_folder(spark, "ask")
    records = qa_records(curated_pairs(spark, sf).pairs, HashingEmbedder(DEFAULT_DIM))
    records.write.mode("overwrite").parquet(f"{run}/index")
    index = spark.read.parquet(f"{run}/index")
    qs = conversation_questions(spark, sf)
    _as_file_stream(qs, f"{run}/in")
    _several(streaming_ask(spark, f"{run}/in", qs.schema, index, f"{run}/answers", f"{run}/ckpt",
                           HashingEmbedder(DEFAULT_DIM), present=lambda a: _answers_out({"answers": a}),
                           max_files_per_trigger=FILES_PER_TRIGGER))
    return spark.read.parquet(f"{run}/answers").drop("batch")


@register("win2_history_state_stream", """
SELECT conv_id, turn, CAST(pos AS BIGINT) AS pos, pos = 1 AS is_latest,
       CASE WHEN length(text) > 60 THEN left(text, 60) || '...' ELSE text END AS preview
FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, text DESC) AS pos FROM conversations)
WHERE pos <= 8""")
def win2_stream(spark: SparkSession, sf: str) -> DataFrame:
    """Turns arrive as a stream; each conversation keeps its newest 8 in bounded state."""
    from ..streaming.history_state import history_stream, latest_history
    run = run_folder(spark, "history")
    conv = A.table(spark, sf, "conversations")
    _as_file_stream(conv, f"{run}/in")
    _several(history_stream(spark, f"{run}/in", conv.schema, "conv_id", "turn", "text", f"{run}/out", f"{run}/ckpt",
                            max_files_per_trigger=FILES_PER_TRIGGER))
    return latest_history(spark, f"{run}/out", "conv_id", "turn")


@register("win2_event_history_stream", """
SELECT user_id, ts_us, CAST(pos AS BIGINT) AS pos, pos = 1 AS is_latest, event_type AS preview
FROM (SELECT user_id, epoch_us(date_trunc('day', ts)) AS ts_us, event_type,
             row_number() OVER (PARTITION BY user_id ORDER BY date_trunc('day', ts) DESC, event_type DESC) AS pos FROM events)
WHERE pos <= 8""")
def win2_event_stream(spark: SparkSession, sf: str) -> DataFrame:
    """Events of a user by day, so that many share a time: none may be lost in the state."""
    from ..streaming.history_state import history_stream, latest_history
    run = run_folder(spark, "event-history")
    ev = A.table(spark, sf, "events").select(
        "user_id", F.unix_micros(F.date_trunc("day", F.col("ts").cast("timestamp"))).alias("ts_us"), "event_type")
    _as_file_stream(ev, f"{run}/in")
    _several(history_stream(spark, f"{run}/in", ev.schema, "user_id", "ts_us", "event_type", f"{run}/out", f"{run}/ckpt",
                            max_files_per_trigger=FILES_PER_TRIGGER))
    return latest_history(spark, f"{run}/out", "user_id", "ts_us")


@register("stm3_sketched_values_stream", """
SELECT event_type, CAST(count(*) AS BIGINT) AS values, min(value) AS least, max(value) AS most, true AS within
FROM events WHERE value IS NOT NULL GROUP BY event_type""")
def stm3_sketches(spark: SparkSession, sf: str) -> DataFrame:
    """Values of the event stream sketched per hour and batch, merged per type; ``within`` tells that the
    exact ranks of the merged median and 90th percentile are inside the stated error."""
    from ..operators.sketches import merge, quantiles, rank_error, sketch_stream
    run = run_folder(spark, "sketches")
    ev = A.table(spark, sf, "events")
    _as_file_stream(ev, f"{run}/in")
    _several(sketch_stream(spark, f"{run}/in", ev.schema, f"{run}/out", f"{run}/ckpt", ["event_type"], "value", "ts",
                           max_files_per_trigger=FILES_PER_TRIGGER))
    got = quantiles(merge(spark.read.parquet(f"{run}/out"), ["event_type"]), ["event_type"])
    v, off = F.col("value").cast("double"), rank_error()
    ranks = (ev.join(F.broadcast(got), "event_type").groupBy("event_type")
             .agg(*[(F.count_if(v < F.col(q)) / F.count("value")).alias(f"below_{q}") for q in ("q50", "q90")],
                  *[(F.count_if(v <= F.col(q)) / F.count("value")).alias(f"upto_{q}") for q in ("q50", "q90")]))
    within = ((F.col("below_q50") <= 0.5 + off) & (F.col("upto_q50") >= 0.5 - off)
              & (F.col("below_q90") <= 0.9 + off) & (F.col("upto_q90") >= 0.9 - off))
    return got.join(ranks, "event_type").select("event_type", "values", "least", "most", within.alias("within"))


HEARTBEAT = -1      # no user has this id


def _in_time_order(df: DataFrame, ts: str, path: str) -> None:
    """``REPLAY_FILES`` files by ranges of ``ts``, written oldest first, then one with a heartbeat a month later."""
    micros = F.unix_micros(ts)
    edges = df.agg(F.percentile_approx(micros, [i / REPLAY_FILES for i in range(1, REPLAY_FILES)]).alias("e")).first()["e"] or []
    number = F.size(F.filter(F.array(*[F.lit(e) for e in edges]), lambda e: e < micros)) if edges else F.lit(0)
    # dealt in one pass by all tasks; then a task reads the rows of its file only
    part = "__replay_file"
    dealt = run_folder(df.sparkSession, "time-ranges")
    df.withColumn(part, number).write.partitionBy(part).parquet(dealt)
    found = {int(n.partition("=")[2]) for n in list_names(df.sparkSession, dealt) if n.startswith(f"{part}=")}
    for k in range(len(edges) + 1):
        rows = (df.sparkSession.read.schema(df.schema).parquet(f"{dealt}/{part}={k}") if k in found
                else df.sparkSession.createDataFrame([], df.schema))
        rows.coalesce(1).write.mode("append").parquet(path)
    tick = df.agg(F.max(ts).alias(ts)).select(*[
        (F.col(ts) + F.expr("INTERVAL 30 DAYS")).alias(c) if c == ts
        else F.lit(HEARTBEAT if c == "user_id" else None).cast(df.schema[c].dataType).alias(c) for c in df.columns])
    tick.coalesce(1).write.mode("append").parquet(path)


@register("rag4_attempt_outcomes_stream", RAG4_SQL)
def rag4_stream(spark: SparkSession, sf: str) -> DataFrame:
    """RAG-4 over two streams: a question per user and day, and the day's attempts, joined under a watermark."""
    from ..streaming.attempts import outcome_stream
    run = run_folder(spark, "attempts")
    # NTZ wall clock as an instant, whatever the session's time zone
    wall = F.timestamp_micros(F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col("ts")))
    attempt_log(spark, sf).withColumn("at", wall).write.parquet(f"{run}/log")     # read several times below
    log = spark.read.parquet(f"{run}/log")
    day = (F.floor(F.unix_micros("at") / F.lit(86_400_000_000)) * 86_400_000_000).cast("long")
    asked = log.select("user_id", "day", F.timestamp_micros(day).alias("asked")).distinct()
    attempts = log.select("user_id", "at", "attempt_id", "model", "error")
    _in_time_order(asked, "asked", f"{run}/questions")
    _in_time_order(attempts, "at", f"{run}/attempts")
    questions = spark.read.parquet(f"{run}/questions")
    _several(outcome_stream(spark, f"{run}/questions", questions.schema, f"{run}/attempts",
                            spark.read.parquet(f"{run}/attempts").schema, f"{run}/out", f"{run}/ckpt", ["user_id"],
                            max_files_per_trigger=FILES_PER_TRIGGER))
    out = spark.read.parquet(f"{run}/out").where(F.col("user_id") != HEARTBEAT).join(asked.select("asked", "day").distinct(), "asked")
    return out.select("user_id", "day", "outcome", "model", "decided_by", "error", "attempts")
