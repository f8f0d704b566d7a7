"""Registered evaluation, history and assembly queries (EVL-*, AGG-4, WIN-2/3, RAG-2/3/4, TOP-3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evaluate as EV
from ..operators import rag
from ..operators.history import HISTORY_DEPTH, PREVIEW_CHARS, recent_history
from ..operators.relational import first_seen_distinct
from . import adapters as A
from . import sqltext as S
from .flagship import _sql_flagship_ctes, flagship_answers
from .registry import LIST_SEP, register

# ---- evaluation rows derived from events -------------------------------------------------
# event type -> (HTTP status, error) of the request it stands for
EVENT_OUTCOMES = {
    "click": (200, None), "view": (200, None), "purchase": (200, None),
    "signup": (500, "Internal Server Error"),
    "error": (None, "Connection refused"),
}


def eval_rows(spark: SparkSession, sf: str) -> DataFrame:
    e = A.table(spark, sf, "events")
    http = None
    err = None
    for t, (code, msg) in EVENT_OUTCOMES.items():
        c = F.lit(code).cast("long") if code is not None else F.lit(None).cast("long")
        m = F.lit(msg) if msg is not None else F.lit(None).cast("string")
        http = F.when(F.col("event_type") == t, c) if http is None else http.when(F.col("event_type") == t, c)
        err = F.when(F.col("event_type") == t, m) if err is None else err.when(F.col("event_type") == t, m)
    status, obs = EV.eval_status(http, err)
    return e.select(F.col("event_id").alias("test_id"), "user_id", "ts", http.alias("http_status"),
                    err.alias("error"), status.alias("status"), obs.alias("observation"),
                    F.round("value", 3).alias("latency_s"))


def _sql_case(col: str, idx: int) -> str:
    parts = []
    for t, vals in EVENT_OUTCOMES.items():
        v = vals[idx]
        parts.append(f"WHEN {S.q(t)} THEN {('NULL' if v is None else (S.q(v) if isinstance(v, str) else str(v)))}")
    cast = "BIGINT" if idx == 0 else "VARCHAR"
    return f"CAST(CASE {col} {' '.join(parts)} END AS {cast})"


SQL_EVAL_ROWS = f"""
er0 AS (SELECT event_id AS test_id, user_id, ts, {_sql_case('event_type', 0)} AS http_status,
               {_sql_case('event_type', 1)} AS error, round(value, 3) AS latency_s FROM events),
er AS (SELECT *, CASE WHEN http_status IS NULL AND error IS NOT NULL THEN 'ERROR' WHEN http_status = 200 THEN 'PASS'
                      ELSE 'FAIL' END AS status FROM er0)"""


@register("evl1_eval_status", f"""
WITH {SQL_EVAL_ROWS}
SELECT test_id, status, CASE status WHEN 'PASS' THEN {S.q(EV.OBS_PASS)}
  WHEN 'FAIL' THEN {S.q(EV.OBS_FAIL_PREFIX)} || coalesce(CAST(http_status AS VARCHAR), 'None') || '.'
  ELSE {S.q(EV.OBS_ERROR)} END AS observation, latency_s FROM er""")
def evl1(spark: SparkSession, sf: str) -> DataFrame:
    return eval_rows(spark, sf).select("test_id", "status", "observation", "latency_s")


_SQL_MS = "CAST(round(latency_s * 1000.0, 0) AS BIGINT)"
_SQL_SUMMARY = ("CAST(count(*) AS BIGINT) AS total, CAST(count_if(status = 'PASS') AS BIGINT) AS passed, "
                "CAST(count(*) - count_if(status = 'PASS') AS BIGINT) AS failed, "
                f"round(CAST(coalesce(sum(CASE WHEN status = 'PASS' THEN coalesce({_SQL_MS}, 0) ELSE 0 END), 0) AS DOUBLE) "
                "/ greatest(count_if(status = 'PASS'), 1), 0) / 1000.0 AS avg_latency")


@register("agg4_eval_summary_by_user", f"WITH {SQL_EVAL_ROWS} SELECT user_id, {_SQL_SUMMARY} FROM er GROUP BY user_id")
def agg4_user(spark: SparkSession, sf: str) -> DataFrame:
    return EV.summarize(eval_rows(spark, sf), ["user_id"])


@register("agg4_eval_summary_total", f"WITH {SQL_EVAL_ROWS} SELECT {_SQL_SUMMARY} FROM er")
def agg4_total(spark: SparkSession, sf: str) -> DataFrame:
    return EV.summarize(eval_rows(spark, sf))


@register("evl3_latency_spread", f"""
WITH {SQL_EVAL_ROWS}
SELECT user_id, CAST(count(*) AS BIGINT) AS n, min(latency_s) AS min_latency, max(latency_s) AS max_latency,
       CAST(sum(CAST(round(latency_s * 1000.0, 0) AS BIGINT)) AS DOUBLE) / count(*) / 1000.0 AS mean_latency, round(quantile_cont(latency_s, 0.5), 6) AS median_latency,
       round(quantile_cont(latency_s, 0.9), 6) AS p90_latency,
       arg_min(test_id, (latency_s, test_id)) AS fastest_id, arg_max(test_id, (latency_s, -test_id)) AS slowest_id
FROM er WHERE status = 'PASS' GROUP BY user_id""")
def evl3(spark: SparkSession, sf: str) -> DataFrame:
    return EV.latency_spread(eval_rows(spark, sf), ["user_id"])


_FLAG = "WITH " + _sql_flagship_ctes()[len("WITH "):]


@register("evl2_report_rows", _FLAG + """
 SELECT p.query_id AS test_id, v.question, CAST(NULL AS DOUBLE) AS latency_s, 'answered' AS status,
        CAST(c.docs_actual AS BIGINT) AS docs, CAST(p.rank - 1 AS INTEGER) AS source_pos, p.title AS source
 FROM parts p JOIN val v USING (query_id) JOIN ctx c USING (query_id)""")
def evl2(spark: SparkSession, sf: str) -> DataFrame:
    """EVL-2: one row per (answered question, source) of the flagship run.  The
    batch run has no per-request wall time, so latency is null."""
    a = (flagship_answers(spark, sf)["answers"].where(F.col("status") == "answered")
         .withColumn("latency_s", F.lit(None).cast("double"))
         .withColumnRenamed("query_id", "test_id"))
    r = EV.report_rows(a).where(F.col("source").isNotNull())
    return r.select("test_id", "question", "latency_s", "status", "docs",
                    F.col("source_pos").cast("int"), "source")


@register("evl2_report_rows_latency", f"""
WITH {SQL_EVAL_ROWS}
SELECT test_id, round(latency_s, 2) AS latency_s, status, CAST(2 AS BIGINT) AS docs, CAST(p.pos AS INTEGER) AS source_pos,
       CASE p.pos WHEN 0 THEN er0_type ELSE 'user ' || user_id END AS source
FROM (SELECT er.*, e.event_type AS er0_type FROM er JOIN events e ON e.event_id = er.test_id), (VALUES (0), (1)) p(pos)""")
def evl2_latency(spark: SparkSession, sf: str) -> DataFrame:
    """EVL-2 over the event log: every row keeps its latency, one row per source."""
    kinds = A.table(spark, sf, "events").select(F.col("event_id").alias("test_id"), "event_type")
    rows = eval_rows(spark, sf).join(kinds, "test_id").withColumn("question", F.lit(None).cast("string")).withColumn(
        "sources", F.array("event_type", F.concat(F.lit("user "), F.col("user_id").cast("string"))))
    r = EV.report_rows(rows)
    return r.select("test_id", "latency_s", "status", "docs", F.col("source_pos").cast("int"), "source")


@register("top3_source_preview", _FLAG + f"""
 SELECT query_id, string_agg(title, {S.q(LIST_SEP)} ORDER BY rank) AS preview FROM parts WHERE rank <= 2 GROUP BY query_id""")
def top3(spark: SparkSession, sf: str) -> DataFrame:
    a = flagship_answers(spark, sf)["answers"].where(F.size("sources") > 0)
    return a.select("query_id", F.array_join(rag.source_preview(F.col("sources"), 2), LIST_SEP).alias("preview"))


@register("rag2_prompt_messages", _FLAG + f""",
 val_ok AS (SELECT v.query_id, v.q, coalesce(c.context, '') AS context FROM val v LEFT JOIN ctx c USING (query_id)
            WHERE v.status = 'ok')
 SELECT query_id, 0 AS msg_pos, 'system' AS role, {S.q(rag.SYSTEM_PROMPT)} AS content FROM val_ok
 UNION ALL
 SELECT query_id, 1 AS msg_pos, 'user' AS role,
        {S.q(rag.QUESTION_PREFIX)} || q || {S.NL} || {S.NL} || {S.q(rag.CONTEXT_HEADING)} || {S.NL} || context
        || {S.NL} || {S.NL} || {S.q(rag.ANSWER_REQUEST)} AS content FROM val_ok""")
def rag2(spark: SparkSession, sf: str) -> DataFrame:
    r = flagship_answers(spark, sf)["requests"]
    m = r.select("query_id", F.posexplode("messages").alias("msg_pos", "m"))
    return m.select("query_id", F.col("msg_pos").cast("int"), F.col("m.role").alias("role"),
                    F.col("m.content").alias("content"))


# ---- RAG-3: candidate models per user from the models their events stand for -------------
EVENT_MODELS = {
    "signup": "llama-3.1-8b-instant",
    "click": "Mixtral-8x7b-32768",
    "view": "gemma2-9b-it",
    "purchase": "whisper-large-v3",
    "error": "llama-3.3-70b-versatile",
}


def _model_col(col):
    expr = None
    for t, m in EVENT_MODELS.items():
        expr = F.when(col == t, F.lit(m)) if expr is None else expr.when(col == t, F.lit(m))
    return expr


def _model_sql(col: str) -> str:
    return "CASE " + col + " " + " ".join(f"WHEN {S.q(t)} THEN {S.q(m)}" for t, m in EVENT_MODELS.items()) + " END"


_FALLBACKS = [m for m in dict.fromkeys([rag.PRIMARY_MODEL, *rag.CANDIDATE_MODELS]) if m]
_FAMILY_SQL = " OR ".join(f"contains(lower(m), {S.q(f)})" for f in rag.PREFERRED_FAMILIES)


@register("rag3_candidate_order", f"""
WITH e AS (SELECT user_id, ts, event_id, {_model_sql('event_type')} AS model FROM events),
f AS (SELECT user_id, model, min((ts, event_id)) AS first FROM e WHERE model IS NOT NULL AND model <> '' GROUP BY ALL),
act AS (SELECT user_id, list(model ORDER BY first) AS active FROM f GROUP BY user_id),
st AS (SELECT user_id, active, CASE WHEN list_contains(active, {S.q(rag.PRIMARY_MODEL)}) THEN {S.q(rag.PRIMARY_MODEL)}
          ELSE coalesce(list_filter(active, lambda m: {_FAMILY_SQL})[1], active[1], {S.q(rag.PRIMARY_MODEL)}) END AS start_model
       FROM act),
arr AS (SELECT user_id, start_model, list_concat([start_model], active, [{', '.join(S.q(m) for m in _FALLBACKS)}]) AS a FROM st),
u AS (SELECT user_id, start_model, unnest(a) AS m, generate_subscripts(a, 1) AS pos FROM arr),
fm AS (SELECT user_id, start_model, m, min(pos) AS pos FROM u WHERE m IS NOT NULL AND m <> '' GROUP BY ALL)
SELECT user_id, start_model, string_agg(m, {S.q(LIST_SEP)} ORDER BY pos) AS candidates FROM fm GROUP BY user_id, start_model""")
def rag3(spark: SparkSession, sf: str) -> DataFrame:
    e = A.table(spark, sf, "events").withColumn("model", _model_col(F.col("event_type")))
    act = first_seen_distinct(e, "user_id", F.col("model"), [F.col("ts"), F.col("event_id")], "active")
    start = rag.start_model(F.col("active"))
    return act.select("user_id", start.alias("start_model"),
                      F.array_join(rag.candidate_order(start, F.col("active")), LIST_SEP).alias("candidates"))


# ---- RAG-4: attempts log = each user's events of one day, in time order ------------------
ATTEMPT_ERRORS = {"error": "model_not_found", "signup": "timeout"}


RAG4_SQL = f"""
WITH a AS (SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, event_id, ts, event_type AS model,
                  CASE event_type {' '.join(f"WHEN {S.q(k)} THEN {S.q(v)}" for k, v in ATTEMPT_ERRORS.items())} END AS error
           FROM events),
r AS (SELECT *, coalesce(contains(error, '404') OR contains(error, 'model_not_found') OR contains(error, 'does not exist'), false) AS retry
      FROM a),
g AS (SELECT user_id, day,
             arg_min({{'attempt_id': event_id, 'model': model, 'error': error}}, CASE WHEN NOT retry THEN (ts, event_id) END) AS d,
             CAST(count(*) AS BIGINT) AS attempts, arg_max(error, (ts, event_id)) AS last_error,
             arg_max(event_id, (ts, event_id)) AS last_attempt
      FROM r GROUP BY user_id, day)
SELECT user_id, day,
       CASE WHEN d IS NULL THEN 'exhausted' WHEN d.error IS NULL THEN 'answered' ELSE 'failed' END AS outcome,
       CASE WHEN d IS NOT NULL AND d.error IS NULL THEN d.model END AS model,
       coalesce(d.attempt_id, last_attempt) AS decided_by,
       CASE WHEN d IS NULL THEN last_error ELSE d.error END AS error, attempts
FROM g"""


@register("rag4_attempt_resolution", RAG4_SQL)
def rag4(spark: SparkSession, sf: str) -> DataFrame:
    return rag.resolve_attempts(attempt_log(spark, sf), ["user_id", "day"], ["ts", "attempt_id"])


def attempt_log(spark: SparkSession, sf: str) -> DataFrame:
    """Each user's events of one day as the attempts of a request, in time order."""
    e = A.table(spark, sf, "events")
    err = None
    for k, v in ATTEMPT_ERRORS.items():
        err = F.when(F.col("event_type") == k, F.lit(v)) if err is None else err.when(F.col("event_type") == k, F.lit(v))
    return e.select("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day"), F.col("event_id").alias("attempt_id"),
                    "ts", F.col("event_type").alias("model"), err.alias("error"))


# ---- WIN-2 / WIN-3 -------------------------------------------------------------------
@register("win2_recent_history", f"""
SELECT conv_id, turn, CAST(pos AS BIGINT) AS pos, pos = 1 AS is_latest,
       CASE WHEN length(text) > {PREVIEW_CHARS} THEN left(text, {PREVIEW_CHARS}) || '...' ELSE text END AS preview
FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS pos FROM conversations)
WHERE pos <= {HISTORY_DEPTH}""")
def win2(spark: SparkSession, sf: str) -> DataFrame:
    c = A.table(spark, sf, "conversations")
    return recent_history(c, "conv_id", "turn", "text")


@register("win2_recent_events_per_user", f"""
SELECT user_id, event_id, CAST(pos AS BIGINT) AS pos, pos = 1 AS is_latest, strftime(ts, '%H:%M') AS hhmm, event_type
FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS pos FROM events)
WHERE pos <= {HISTORY_DEPTH}""")
def win2_events(spark: SparkSession, sf: str) -> DataFrame:
    """WIN-2/3 over the event log: each user's newest entries, newest first, with clock labels."""
    from pyspark.sql import Window
    from ..functions.text import clock_label
    e = A.table(spark, sf, "events")
    w = Window.partitionBy("user_id").orderBy(F.col("ts").desc(), F.col("event_id").desc())
    r = e.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= HISTORY_DEPTH)
    return r.select("user_id", "event_id", F.col("pos").cast("long"), (F.col("pos") == 1).alias("is_latest"),
                    clock_label(F.col("ts")).alias("hhmm"), "event_type")


@register("win3_latest_and_previous", """
SELECT conv_id, turn, turn = max(turn) OVER (PARTITION BY conv_id) AS is_latest,
       'Q: ' || left(text, 80) || '...' AS label
FROM conversations""")
def win3(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.history import latest_and_previous
    return latest_and_previous(A.table(spark, sf, "conversations"), "conv_id", "turn", "text")
