"""Streaming forms equal their batch twins; driver contract smoke checks."""
import os

import pytest

from pyspark.sql import functions as F

import __spark_entry__ as E
from kbforge.streaming.index_load import incremental_index_load
from kbforge.streaming.metrics import request_counts

from conftest import SF001


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns == ["query_id", "question", "status", "answer", "sources", "model", "docs_retrieved", "docs_actual"]


def test_oracle_keys_are_registered():
    assert set(E.oracle_sql()) <= set(E.queries())
    assert len(E.queries()) >= 50


def test_streaming_counts_equal_batch(spark):
    q = E.queries()
    s = q["stm3_request_counts_stream"](spark, SF001)
    b = request_counts(spark.read.parquet(f"{SF001}/events.parquet"))
    assert s.exceptAll(b).count() == 0 and b.exceptAll(s).count() == 0


def test_incremental_load_is_idempotent_on_replay(spark, tmp_dir):
    docs = spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text")
    src = f"{tmp_dir}/in"
    docs.repartition(3).write.parquet(src)

    def to_records(b):
        return b.select(F.col("doc_id").alias("key"), F.col("doc_id").cast("string").alias("id"),
                        F.col("text").alias("document"), F.array(F.lit(1.0)).alias("embedding"),
                        F.struct(F.lit("t").alias("title"), F.lit(0).alias("question_score"),
                                 F.lit(0).alias("answer_score")).alias("meta"))

    coll = f"{tmp_dir}/coll"
    incremental_index_load(spark, src, docs.schema, to_records, coll, f"{tmp_dir}/ck1", max_files_per_trigger=1)
    # a second query with a fresh checkpoint replays every file: nothing is added twice
    incremental_index_load(spark, src, docs.schema, to_records, coll, f"{tmp_dir}/ck2")
    out = spark.read.parquet(coll)
    assert out.count() == docs.count() == out.select("id").distinct().count()
    assert len([n for n in os.listdir(coll) if n.startswith("batch=")]) >= 2


def test_append_mode_windows_are_final(spark, tmp_dir):
    from kbforge.streaming.ask_stream import request_metrics_to_table
    ev = spark.read.parquet(f"{SF001}/events.parquet")
    ev.orderBy("ts").repartitionByRange(4, "ts").write.parquet(f"{tmp_dir}/in")
    request_metrics_to_table(spark, f"{tmp_dir}/in", ev.schema, f"{tmp_dir}/out", f"{tmp_dir}/ck",
                             "1 hour", "1 day", max_files_per_trigger=1, output_mode="append")
    out = spark.read.parquet(f"{tmp_dir}/out").drop("epoch")
    batch = request_counts(ev)
    assert out.count() > 0
    assert out.exceptAll(batch).count() == 0          # every emitted window is final and exact
    assert out.count() <= batch.count()               # the last open windows are not emitted yet


def test_history_state_rerun_epoch_is_idempotent(spark, tmp_dir):
    from kbforge.streaming.history_state import history_stream, latest_history
    conv = spark.read.parquet(f"{SF001}/conversations.parquet")
    conv.repartition(3).write.parquet(f"{tmp_dir}/in")
    history_stream(spark, f"{tmp_dir}/in", conv.schema, "conv_id", "turn", "text", f"{tmp_dir}/out",
                   f"{tmp_dir}/ck", max_files_per_trigger=1)
    n_first = latest_history(spark, f"{tmp_dir}/out", "conv_id", "turn").count()
    # simulate a re-run of the last micro-batch: its folder is rewritten, not appended
    import os
    last = max(int(d.split("=")[1]) for d in os.listdir(f"{tmp_dir}/out") if d.startswith("epoch="))
    again = spark.read.parquet(f"{tmp_dir}/out/epoch={last}")
    again.write.mode("overwrite").parquet(f"{tmp_dir}/out_tmp")
    spark.read.parquet(f"{tmp_dir}/out_tmp").write.mode("overwrite").parquet(f"{tmp_dir}/out/epoch={last}")
    second = latest_history(spark, f"{tmp_dir}/out", "conv_id", "turn")
    assert n_first == second.count() == conv.groupBy("conv_id").count().selectExpr(
        "sum(least(count, 8))").first()[0]


def test_time_outputs_do_not_depend_on_session_zone(spark):
    from kbforge.functions.text import clock_label, elapsed_seconds
    ev = spark.read.parquet(f"{SF001}/events.parquet")

    def snapshot():
        counts = sorted(tuple(r) for r in request_counts(ev).collect())
        g = ev.groupBy("user_id").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
        el = sorted(tuple(r) for r in g.select("user_id", elapsed_seconds(F.col("a"), F.col("b"))).collect())
        hm = sorted(tuple(r) for r in ev.select("event_id", clock_label(F.col("ts"))).collect())
        return counts, el, hm

    base = snapshot()
    try:
        for tz in ("Asia/Kolkata", "America/New_York"):
            spark.conf.set("spark.sql.session.timeZone", tz)
            assert snapshot() == base, tz
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_entry_module_imports_without_a_session():
    import subprocess
    import sys
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = "import __spark_entry__ as E; print(len(E.queries()), len(E.oracle_sql()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr[-2000:]
    n_q, n_sql = map(int, out.stdout.split())
    assert n_q >= n_sql >= 60


def test_history_state_keeps_entries_of_one_time(spark, tmp_dir):
    from kbforge.operators.history import recent_history
    from kbforge.streaming.history_state import history_stream, latest_history
    rows = [(1, 5, "a"), (1, 5, "b"), (1, 5, "b"), (1, 4, None), (2, 1, "x")] + [(3, k // 3, f"e{k}") for k in range(40)]
    df = spark.createDataFrame(rows, "s long, t long, text string")
    df.repartition(5).write.parquet(f"{tmp_dir}/in")
    history_stream(spark, f"{tmp_dir}/in", df.schema, "s", "t", "text", f"{tmp_dir}/out", f"{tmp_dir}/ck",
                   max_files_per_trigger=1)
    got = sorted(map(str, latest_history(spark, f"{tmp_dir}/out", "s", "t").collect()))
    assert got == sorted(map(str, recent_history(df, "s", "t", "text").collect()))


def test_known_questions_are_not_embedded_again(spark, tmp_dir):
    from kbforge.streaming.index_load import incremental_index_load
    docs = spark.createDataFrame([(i, f"t{i}") for i in range(20)], "doc_id long, text string")
    docs.repartition(4).write.parquet(f"{tmp_dir}/in")
    seen = []

    def to_records(b):
        seen.append(b.count())
        return b.select(F.col("doc_id").alias("key"), F.col("doc_id").cast("string").alias("id"),
                        F.col("text").alias("document"))

    for run in ("a", "b"):
        incremental_index_load(spark, f"{tmp_dir}/in", docs.schema, to_records, f"{tmp_dir}/coll", f"{tmp_dir}/{run}",
                               max_files_per_trigger=2, source_id=F.col("doc_id").cast("string"))
    assert sum(seen) == 20 and spark.read.parquet(f"{tmp_dir}/coll").count() == 20


def _numbered_files(spark, folder, files, rows, first=0):
    for f in range(first, first + files):
        (spark.createDataFrame([(f * rows + i - (1 if i == 0 and f else 0), f"text {f} {i}") for i in range(rows)],
                               "doc_id long, text string").coalesce(1).write.mode("append").parquet(folder))


def _plain_records(b):
    return b.select(F.col("doc_id").cast("string").alias("id"), F.col("text").alias("document"))


def test_a_batch_reads_none_of_its_own_history(spark, tmp_dir, monkeypatch):
    """Fifty micro-batches: state grows by the ids alone, and nothing written before is read again."""
    from kbforge.streaming import index_load
    read = []
    monkeypatch.setattr(index_load, "written_elsewhere", lambda *a: read.append(written(*a)) or read[-1])
    written = __import__("kbforge.streaming.batches", fromlist=["x"]).written_elsewhere
    _numbered_files(spark, f"{tmp_dir}/in", 50, 4)
    schema = spark.read.parquet(f"{tmp_dir}/in").schema
    batches = index_load.incremental_index_load(spark, f"{tmp_dir}/in", schema, _plain_records, f"{tmp_dir}/coll",
                                                f"{tmp_dir}/ck", max_files_per_trigger=1,
                                                source_id=F.col("doc_id").cast("string"))
    assert batches == 50 and read == [None] * 50
    # each file but the first repeats the last id of the one before it
    ids = [r.id for r in spark.read.parquet(f"{tmp_dir}/coll").select("id").collect()]
    assert len(ids) == len(set(ids)) == 50 * 4 - 49
    again = index_load.incremental_index_load(spark, f"{tmp_dir}/in", schema, _plain_records, f"{tmp_dir}/coll",
                                              f"{tmp_dir}/ck", max_files_per_trigger=1, source_id=F.col("doc_id").cast("string"))
    assert again == 0 and spark.read.parquet(f"{tmp_dir}/coll").count() == len(ids)


def test_a_batch_run_again_after_a_loss_adds_nothing(spark, tmp_dir):
    """The last commit of the checkpoint is lost: its batch runs again from the state before it."""
    import os

    from kbforge.streaming.index_load import incremental_index_load
    _numbered_files(spark, f"{tmp_dir}/in", 4, 5)
    schema = spark.read.parquet(f"{tmp_dir}/in").schema

    def load():
        return incremental_index_load(spark, f"{tmp_dir}/in", schema, _plain_records, f"{tmp_dir}/coll", f"{tmp_dir}/ck",
                                      max_files_per_trigger=2, source_id=F.col("doc_id").cast("string"))

    assert load() == 2
    want = sorted(r.id for r in spark.read.parquet(f"{tmp_dir}/coll").collect())
    for name in ("1", ".1.crc"):
        path = f"{tmp_dir}/ck/commits/{name}"
        if os.path.exists(path):
            os.remove(path)
    assert load() == 1                                       # the uncommitted batch, once more
    assert sorted(r.id for r in spark.read.parquet(f"{tmp_dir}/coll").collect()) == want
    _numbered_files(spark, f"{tmp_dir}/in", 1, 5, first=4)
    assert load() == 1 and spark.read.parquet(f"{tmp_dir}/coll").count() == len(want) + 4


def test_ids_are_forgotten_after_their_time(spark, tmp_dir):
    import os
    import time

    from kbforge.streaming.index_load import incremental_index_load
    schema, now = "doc_id long, text string", time.time()
    os.makedirs(f"{tmp_dir}/all")
    for k, age in enumerate((7200, 3600, 0)):                # the same id, in files an hour apart
        spark.createDataFrame([(1, f"v{k}"), (10 + k, "x")], schema).coalesce(1).write.parquet(f"{tmp_dir}/in{k}")
        part = next(f"{tmp_dir}/in{k}/{n}" for n in os.listdir(f"{tmp_dir}/in{k}") if n.startswith("part-"))
        os.replace(part, f"{tmp_dir}/all/{k}.parquet")
        os.utime(f"{tmp_dir}/all/{k}.parquet", (now - age, now - age))
        for keep, want in ((None, 1), ("1 day", 1), ("10 minutes", 1 + k // 2)):
            out = f"{tmp_dir}/coll-{keep}"
            incremental_index_load(spark, f"{tmp_dir}/all", spark.read.parquet(f"{tmp_dir}/all").schema, _plain_records, out,
                                   f"{tmp_dir}/ck-{keep}", source_id=F.col("doc_id").cast("string"), keep_ids_for=keep)
            got = spark.read.parquet(out)
            # the second file still meets the state; it moves the watermark past the first one's time
            assert got.where("id = '1'").count() == want and got.count() == want + k + 1


def test_registered_streams_run_in_several_batches(spark):
    import __spark_entry__ as E
    from kbforge.plans import q_streaming as Q
    with pytest.raises(RuntimeError, match="micro-batches"):
        Q._several(1)
    seen = []
    for name in ("stm1_incremental_index", "stm3_request_counts_stream", "win2_event_history_stream"):
        before = Q._several
        try:
            Q._several = lambda n: (seen.append(n), before(n))
            E.queries()[name](spark, SF001).count()
        finally:
            Q._several = before
    assert len(seen) == 3 and all(n >= 3 for n in seen)


def test_attempt_outcomes_stream_equals_the_batch(spark, tmp_dir):
    """Answered, failed and exhausted requests, one nobody attempted, and an open one that waits."""
    from kbforge.streaming.attempts import outcome_stream, outcomes
    t = lambda h: f"2024-01-{1 + h // 24:02d} {h % 24:02d}:00:00"
    questions = [(1, 0), (2, 1), (3, 2), (4, 30), (5, 31), (6, 200), (2, 60)]
    attempts = [(1, 1, 10, "m1", "404 gone"), (1, 2, 11, "m2", None), (1, 3, 12, "m3", "boom"),       # answered by the second
                (2, 2, 13, "m1", "boom"), (2, 3, 14, "m2", None),                                     # failed at the first
                (3, 3, 15, "m1", "model_not_found"), (3, 4, 16, "m2", "404"),                         # exhausted
                (5, 80, 17, "m1", None),                                                              # after its time
                (2, 61, 18, "m9", None),                                                              # asked again later
                (6, 201, 19, "m1", None)]
    q_all = spark.createDataFrame([(r, t(h)) for r, h in questions], "req long, asked string").withColumn(
        "asked", F.to_timestamp("asked"))
    a_all = spark.createDataFrame([(r, t(h), i, m, e) for r, h, i, m, e in attempts],
                                  "req long, at string, attempt_id long, model string, error string").withColumn(
        "at", F.to_timestamp("at"))
    for name, df, ts in (("q", q_all, "asked"), ("a", a_all, "at")):
        for low, high in ((0, 3), (3, 50), (50, 100), (100, 300)):
            part = df.where((F.col(ts) >= F.to_timestamp(F.lit(t(low)))) & (F.col(ts) < F.to_timestamp(F.lit(t(high)))))
            part.coalesce(1).write.mode("append").parquet(f"{tmp_dir}/{name}")
    run = lambda: outcome_stream(spark, f"{tmp_dir}/q", q_all.schema, f"{tmp_dir}/a", a_all.schema, f"{tmp_dir}/out",
                                 f"{tmp_dir}/ck", ["req"], max_files_per_trigger=1, timeout="1 day", late="1 hour")
    assert run() >= 4
    got = {(r.req, str(r.asked)): (r.outcome, r.model, r.decided_by, r.error, r.attempts)
           for r in spark.read.parquet(f"{tmp_dir}/out").collect()}
    want = {(r.req, str(r.asked)): (r.outcome, r.model, r.decided_by, r.error, r.attempts)
            for r in outcomes(q_all, a_all, ["req"], timeout="1 day").collect()}
    still_open = {k for k in want if k[0] == 6}
    assert got == {k: v for k, v in want.items() if k not in still_open}
    assert {k[0]: v[0] for k, v in got.items() if k != (2, t(60))} == {
        1: "answered", 2: "failed", 3: "exhausted", 4: "exhausted", 5: "exhausted"}
    assert got[4, t(30)][4] == 0 and got[1, t(0)][1:3] == ("m2", 11)
    # a heartbeat on both streams closes the log
    for name, schema, row in (("q", q_all.schema, (-1, t(400))), ("a", a_all.schema, (-1, t(400), None, None, None))):
        ts = "asked" if name == "q" else "at"
        beat = spark.createDataFrame([row], ", ".join(f"{f.name} {'string' if f.name == ts else f.dataType.simpleString()}" for f in schema))
        beat.withColumn(ts, F.to_timestamp(ts)).coalesce(1).write.mode("append").parquet(f"{tmp_dir}/{name}")
    assert run() >= 1
    assert spark.read.parquet(f"{tmp_dir}/out").where("req = 6 and outcome = 'answered'").count() == 1
