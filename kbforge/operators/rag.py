"""Answer assembly over retrieval results (RAG-1 ... RAG-6, AGG-5, AGG-6, TOP-3).

Every per-question list here has at most ``k`` elements (the retrieval depth), so
``collect_list`` per question is bounded by construction.
"""

from __future__ import annotations

import inspect
import threading
import time
import uuid
from concurrent.futures import ThreadPoolExecutor
from contextlib import nullcontext
from typing import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import RETRY_MARKERS as RETRY_MARKERS_PY
from ..functions.text import default_score, default_title, fixed1, is_retry_error, relevance_pct
from ..session import list_names, path_exists, run_folder

# ---------------------------------------------------------------------------
# Fixed values (prompt and context text the generator sees)
# ---------------------------------------------------------------------------
SYSTEM_PROMPT = """You are an expert Python programming assistant powered by real Stack Overflow data.

Rules:
1. Answer ONLY based on the Stack Overflow context provided below.
2. If the context does not fully cover the question, say so briefly, then answer from your knowledge.
3. Always include working code examples in Python using markdown code blocks (```python ... ```).
4. Be concise but complete — avoid unnecessary padding.
5. If multiple approaches exist, list them with trade-offs.
"""
RESULT_LABEL = "Stack Overflow Result"
QUESTION_PREFIX = "Python Question: "
CONTEXT_HEADING = "Stack Overflow Context:"
ANSWER_REQUEST = "Please answer the question based on the context above."
PART_SEPARATOR = "\n\n"
# Retrieval depth reported in every answer record.
TOP_K = 5
# Default primary model and the fallback candidates, in order.
PRIMARY_MODEL = "llama-3.3-70b-versatile"
CANDIDATE_MODELS = [
    "llama-3.3-70b-versatile",
    "llama-3.1-8b-instant",
    "llama-3.2-11b-vision-preview",
    "llama-3.2-90b-vision-preview",
    "llama3-70b-8192",
    "llama3-8b-8192",
    "mixtral-8x7b-32768",
    "gemma2-9b-it",
]
PREFERRED_FAMILIES = ["llama", "mixtral", "gemma"]
# ---------------------------------------------------------------------------


def context_part(rank: Column, title: Column, score: Column, distance: Column, document: Column,
                 label: str = RESULT_LABEL) -> Column:
    """RAG-1: one retrieved result rendered for the prompt."""
    return F.concat(
        F.lit(f"--- {label} "), rank.cast("string"), F.lit(" ---\nTitle: "), default_title(title),
        F.lit(" (votes: "), default_score(score).cast("string"), F.lit(")\nRelevance: "),
        fixed1(relevance_pct(distance)), F.lit("%\n\n"), document)


def assemble_context(hits: DataFrame, label: str = RESULT_LABEL) -> DataFrame:
    """RAG-1 + AGG-5 + AGG-6 + RAG-6 (lists): per query the context block, source
    titles in rank order, the number of documents actually returned and the rank-1 document.

    ``hits`` columns: query_id, rank, distance, document, title, question_score.
    """
    parts = hits.select(
        "query_id", "rank",
        context_part(F.col("rank"), F.col("title"), F.col("question_score"), F.col("distance"),
                     F.col("document"), label).alias("part"),
        default_title(F.col("title")).alias("title"), "document")
    g = parts.groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", "part", "title", "document"))).alias("_r"))
    return g.select(
        "query_id",
        F.array_join(F.transform("_r", lambda x: x["part"]), PART_SEPARATOR).alias("context"),
        F.transform("_r", lambda x: x["title"]).alias("sources"),
        F.size("_r").cast("long").alias("docs_actual"),
        F.col("_r")[0]["document"].alias("top_document"))


def user_message(question: Column, context: Column) -> Column:
    """RAG-2: the user turn of the prompt."""
    return F.concat(F.lit(QUESTION_PREFIX), question, F.lit(f"\n\n{CONTEXT_HEADING}\n"), context,
                    F.lit(f"\n\n{ANSWER_REQUEST}"))


def prompt_messages(question: Column, context: Column, system: str = SYSTEM_PROMPT) -> Column:
    """RAG-2: ``[{role: system, ...}, {role: user, ...}]``."""
    return F.array(
        F.struct(F.lit("system").alias("role"), F.lit(system).alias("content")),
        F.struct(F.lit("user").alias("role"), user_message(question, context).alias("content")))


def source_preview(sources: Column, n: int = 2) -> Column:
    """TOP-3: first ``n`` sources."""
    return F.slice(sources, 1, n)


def candidate_order(current: Column, active: Column, primary: str = PRIMARY_MODEL,
                    fallbacks: Sequence[str] = CANDIDATE_MODELS) -> Column:
    """RAG-3 / SET-3: current model, then active models, then fallbacks; empty
    names removed, duplicates removed keeping the first occurrence."""
    fb = [m for m in dict.fromkeys([primary, *fallbacks]) if m]
    arr = F.concat(F.array(current), F.coalesce(active, F.array().cast("array<string>")),
                   F.array(*[F.lit(m) for m in fb]))
    return F.array_distinct(F.filter(arr, lambda x: x.isNotNull() & (x != "")))


def start_model(active: Column, primary: str = PRIMARY_MODEL,
                families: Sequence[str] = PREFERRED_FAMILIES) -> Column:
    """RAG-3: primary if active; else first active of a preferred family
    (case-insensitive substring); else first active; else primary."""
    def preferred(m):
        cond = F.lit(False)
        for fam in families:
            cond = cond | F.lower(m).contains(fam)
        return cond
    act = F.coalesce(active, F.array().cast("array<string>"))
    return (F.when(F.array_contains(act, F.lit(primary)), F.lit(primary))
            .otherwise(F.coalesce(F.get(F.filter(act, preferred), 0), F.get(act, 0), F.lit(primary))))


def resolve_attempts(attempts: DataFrame, request: Sequence[str], order: Sequence[str],
                     attempt_id: str = "attempt_id", model: str = "model", error: str = "error",
                     present: Column | None = None) -> DataFrame:
    """RAG-4: outcome per request from an attempts log.

    Attempts are tried in ``order``; retry-class errors (STR-8) move on, the
    first other attempt decides: no error -> ``answered`` with its model, an
    error -> ``failed``.  No deciding attempt -> ``exhausted`` (with the last error;
    ``decided_by`` is then the last attempt).

    One partial ``min_by`` aggregation per request, ordered by a struct of the
    ordering columns (no window): a request with a third of all attempts still
    combines map-side.  Rows that are not ``present`` (of requests without any attempt,
    from an outer join) decide and count nothing.
    """
    pos = F.struct(*[F.col(c) for c in order])
    here = F.lit(True) if present is None else present
    a = attempts.withColumn("_retry", is_retry_error(F.col(error)) | ~here)
    g = a.groupBy(*request).agg(
        F.min_by(F.struct(F.col(attempt_id).alias("attempt_id"), F.col(model).alias("model"),
                          F.col(error).alias("error")),
                 F.when(~F.col("_retry"), pos)).alias("_d"),
        F.count(F.when(here, 1)).cast("long").alias("attempts"),
        F.max_by(F.col(error), pos).alias("_last_error"),
        F.max_by(F.col(attempt_id), pos).alias("_last_attempt"))
    return g.select(
        *request,
        F.when(F.col("_d").isNull(), F.lit("exhausted"))
         .when(F.col("_d.error").isNull(), F.lit("answered"))
         .otherwise(F.lit("failed")).alias("outcome"),
        F.when(F.col("_d").isNotNull() & F.col("_d.error").isNull(), F.col("_d.model")).alias("model"),
        # the attempt at which the outcome was settled (the last one when exhausted)
        F.coalesce(F.col("_d.attempt_id"), F.col("_last_attempt")).alias("decided_by"),
        F.when(F.col("_d").isNull(), F.col("_last_error")).otherwise(F.col("_d.error")).alias("error"),
        "attempts")


# --- generation (RAG-5) -------------------------------------------------------------
# Sampling parameters of a generation call.
GENERATION_PARAMS = {"temperature": 0.1, "max_tokens": 1024}


def _accepted(gen: Callable, params: dict) -> dict:
    """The parameters that ``gen`` takes by name (all, if it takes any keyword)."""
    taken = inspect.signature(gen).parameters.values()
    if any(p.kind is p.VAR_KEYWORD for p in taken):
        return dict(params)
    names = {p.name for p in taken}
    return {k: v for k, v in params.items() if k in names}


def extractive_answers(df: DataFrame, document_col: str = "top_document", candidates_col: str = "candidates",
                       keep: Sequence[str] = ("query_id",)) -> DataFrame:
    """The default offline generation as columns: the answer part of the rank-1 document.

    Same columns as :func:`generate`; no call is made, so ``latency_s`` is null.
    """
    doc = F.coalesce(F.col(document_col), F.lit(""))
    at = F.instr(doc, ANSWER_MARKER)
    return df.select(
        *keep,
        F.when(at > 0, F.substr(doc, at + len(ANSWER_MARKER))).otherwise(doc).alias("answer"),
        F.try_element_at(candidates_col, F.lit(1)).alias("model"), F.lit("answered").alias("status"),
        F.lit(None).cast("string").alias("error"), F.lit(None).cast("double").alias("latency_s"))


def _extractive_factory():
    return extractive_generator


def _factory_key(factory) -> str:
    name = getattr(factory, "__qualname__", "")
    if not name or "<lambda>" in name or "<locals>" in name:
        return uuid.uuid4().hex   # anonymous factory: no stable identity to share
    return f"{getattr(factory, '__module__', '')}.{name}"


# Where the answer begins in an indexed document (STR-4).
ANSWER_MARKER = "\n\nA: "


class ModelUnavailable(Exception):
    """Raised by a generator when a model does not exist (a retry-class error)."""


def extractive_answer(document: str | None) -> str:
    """Default offline generator core: the answer part of a retrieved document."""
    if not document:
        return ""
    i = document.find(ANSWER_MARKER)
    return document[i + len(ANSWER_MARKER):] if i >= 0 else document


def extractive_generator(model: str, messages: list[dict]) -> str:
    """Offline ``generate(model, messages)``: answers with the answer section of
    the rank-1 result found in the user message."""
    user = next((m["content"] for m in messages if m["role"] == "user"), "")
    head = f"--- {RESULT_LABEL} 1 ---"
    start = user.find(head)
    if start < 0:
        return ""
    body_start = user.find("\n\n", user.find("\nRelevance: ", start)) + 2
    end = user.find(f"\n\n--- {RESULT_LABEL} 2 ---", body_start)
    if end < 0:
        end = user.rfind(f"\n\n{ANSWER_REQUEST}")
    return extractive_answer(user[body_start:end])


GENERATION_FIELDS = [
    T.StructField("answer", T.StringType()),
    T.StructField("model", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("error", T.StringType()),
    T.StructField("latency_s", T.DoubleType()),   # wall time of the generation calls for the row
]


# Per Python-worker state: the generator instance and the last model that
# answered, keyed by a token of each ``generate`` call.  Module globals live as
# long as the (reused) worker process, unlike closure state, which is rebuilt
# every time a task deserialises the function.
_WORKER_STATE: dict = {}


# Parts of error messages with which a model refuses a call that may be made again later.
BUSY_MARKERS = ("429", "rate limit", "rate_limit", "overloaded")


class _Pace:
    """Spaces the calls that one worker begins, model by model."""

    def __init__(self, calls_per_second: float | None):
        self.gap = 1.0 / calls_per_second if calls_per_second else 0.0
        self.lock, self.free = threading.Lock(), {}

    def wait(self, model: str) -> None:
        if not self.gap:
            return
        with self.lock:
            begin = max(time.monotonic(), self.free.get(model, 0.0))
            self.free[model] = begin + self.gap
        time.sleep(max(0.0, begin - time.monotonic()))


def generate(df: DataFrame, generator_factory: Callable[[], Callable[[str, list], str]] | None = None,
             messages_col: str = "messages", candidates_col: str = "candidates",
             keep: Sequence[str] = ("query_id",), cache_key: str | None = None,
             params: dict | None = None, in_flight: int = 1, calls_per_second: float | None = None,
             busy_retries: int = 0, busy_wait_s: float = 1.0, busy_markers: Sequence[str] = BUSY_MARKERS) -> DataFrame:
    """RAG-5: ``mapInPandas`` that calls ``generate(model, messages)`` per row,
    trying candidate models in order with RAG-4 semantics.

    The generator is created once per Python worker; the last model that answered
    is tried first for later rows of that worker (a per-worker cache, never a
    global).  Errors become a per-row status instead of failing the job.  The
    ``keep`` columns pass through unchanged, so no join back is needed.

    The worker cache is keyed by ``cache_key`` (default: the factory's module and
    qualified name), so repeated calls (one per streaming micro-batch) reuse the
    generator already loaded in each worker instead of loading another.

    ``params`` (default :data:`GENERATION_PARAMS`) go to the generator by name, as far
    as it takes them.

    A worker has up to ``in_flight`` calls open at a time (the generator must then allow
    threads); rows come out in their order.  ``calls_per_second`` bounds the calls that a
    worker begins per model.  A call refused with one of ``busy_markers`` in its error is
    made again up to ``busy_retries`` times, after ``busy_wait_s`` and twice as long each
    time; then the error counts as any other.
    """
    params = GENERATION_PARAMS if params is None else params
    factory = generator_factory or _extractive_factory
    token = cache_key or _factory_key(factory)
    retry_markers = tuple(RETRY_MARKERS_PY)
    keep = list(keep)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from kbforge.operators import rag as _self   # the worker's module instance
        holder = _self._WORKER_STATE.setdefault(token, {})
        if "gen" not in holder:
            holder["gen"] = factory()
            holder["last_good"] = None
        gen = holder["gen"]
        options = _accepted(gen, params)
        pace = holder.setdefault("pace", _self._Pace(calls_per_second))

        def call(model: str, messages: list) -> str:
            for attempt in range(busy_retries + 1):
                pace.wait(model)
                try:
                    return gen(model, messages, **options)
                except Exception as e:  # noqa: BLE001 - only refusals are made again
                    if attempt == busy_retries or not any(k in str(e) for k in busy_markers):
                        raise
                    time.sleep(busy_wait_s * 2 ** attempt)
            raise AssertionError

        def answer_row(row: tuple) -> tuple:
            msgs, cands = row
            t0 = time.perf_counter()
            messages = [{"role": m["role"], "content": m["content"]} for m in msgs]
            order = list(dict.fromkeys(
                ([holder["last_good"]] if holder["last_good"] else []) + [c for c in cands if c]))
            answer = model_used = err = None
            status = "exhausted"
            for model in order:
                try:
                    answer = call(model, messages)
                    model_used, status, err = model, "answered", None
                    holder["last_good"] = model
                    break
                except Exception as e:  # noqa: BLE001 - classify any generator error
                    err = str(e)
                    if isinstance(e, ModelUnavailable) or any(k in err for k in retry_markers):
                        continue
                    status = "failed"
                    break
            return answer, model_used, status, err, round(time.perf_counter() - t0, 3)

        # map() keeps the order of the rows, and the pool the number of open calls
        with ThreadPoolExecutor(in_flight) if in_flight > 1 else nullcontext() as pool:
            for pdf in batches:
                rows = zip(pdf[messages_col], pdf[candidates_col])
                done = list((pool.map if pool else map)(answer_row, rows))
                out = pdf[keep].copy()
                for k, name in enumerate(("answer", "model", "status", "error", "latency_s")):
                    out[name] = [d[k] for d in done]
                yield out

    src = df.select(*keep, messages_col, candidates_col)
    schema = T.StructType([df.schema[c] for c in keep] + GENERATION_FIELDS)
    return src.mapInPandas(run, schema)


def generate_to(df: DataFrame, path: str, generator_factory: Callable | None = None, keep: Sequence[str] = ("query_id",),
                rows_per_task: int = 200, **how) -> DataFrame:
    """:func:`generate` into a table that a later call continues; returns all rows of the table.

    Rows whose ``keep[0]`` is in the table already are not generated again.  A task has
    about ``rows_per_task`` rows and no input but its own, so a lost executor repeats
    only the calls of the tasks that it had not finished.  Each call writes a folder of
    its own, which counts once it is complete.
    """
    spark = df.sparkSession
    done = [n for n in list_names(spark, path) if n.startswith("run=") and path_exists(spark, f"{path}/{n}/_SUCCESS")]
    known = [f"{path}/{n}" for n in sorted(done)]
    if known:
        seen = spark.read.parquet(*known).select(F.col(keep[0]).alias("_seen"))
        df = df.join(seen, F.col(keep[0]).eqNullSafe(F.col("_seen")), "left_anti")
    staged = run_folder(spark, "to-generate")       # counted and dealt without computing the messages twice
    df.write.parquet(staged)
    rows = spark.read.parquet(staged)
    tasks = -(-rows.count() // rows_per_task)
    if tasks:
        new = f"{path}/run={uuid.uuid4().hex}"
        generate(rows.repartition(tasks), generator_factory, keep=keep, **how).write.parquet(new)
        known.append(new)
    if not known:
        return generate(rows, generator_factory, keep=keep, **how)
    return spark.read.parquet(*known)
