"""RAG-7: answer a whole table of questions against a collection.

question table -> validation (FLT-3) -> embed (VEC-1) -> exact top-k (VEC-3)
-> payload join -> context and prompt (RAG-1/2) -> generation with model
fallback (RAG-3/4/5) -> answer records (RAG-6).  Rejected questions keep a
per-row status instead of failing the batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import validate_question
from ..functions.vectors import HashingEmbedder
from ..operators import rag
from ..operators.knn import knn_search
from ..session import broadcast_limit

# Estimated bytes of one retrieval hit row (query_id, rank, key, distance).
HIT_ROW_BYTES = 32


def validated(questions: DataFrame, text_col: str = "question") -> DataFrame:
    status, clean = validate_question(F.col(text_col))
    return questions.select("query_id", F.col(text_col).alias("question"),
                            status.alias("status"), clean.alias("q"))


def split_questions(questions: DataFrame, text_col: str = "question") -> tuple[DataFrame, DataFrame]:
    """FLT-3 as a quarantine split: (valid questions with stripped text ``q``,
    rejected questions with their ``status``) — both from one validated frame."""
    v = validated(questions, text_col)
    return v.where(F.col("status") == "ok"), v.where(F.col("status") != "ok")


def exact_search(dim: int | None = None):
    """Retrieval by exact k-NN (VEC-3): every question scans the whole index.
    Cost grows with (number of query blocks) x (index size)."""
    def search(spark: SparkSession, index: DataFrame, qv: DataFrame, k: int) -> DataFrame:
        return knn_search(spark, index, qv, k, corpus_id="key", corpus_vec="embedding",
                          query_id="query_id", query_vec="embedding", dim=dim)
    return search


def ivf_searcher(ivf_index, nprobe: int):
    """Retrieval through a clustered index (VEC-4): each question reads only its
    ``nprobe`` clusters; the scalable choice for very large question sets."""
    from ..operators.ivf import ivf_search

    def search(spark: SparkSession, index: DataFrame, qv: DataFrame, k: int) -> DataFrame:
        return ivf_search(spark, ivf_index, qv, k, nprobe=nprobe, query_id="query_id", query_vec="embedding")
    return search


def retrieve(spark: SparkSession, ok: DataFrame, index: DataFrame, embedder, k: int, search=None) -> DataFrame:
    """VEC-1 + retrieval for validated questions: (query_id, rank, key, distance)."""
    qv = embedder.embed(ok.select("query_id", "q"), "q", "embedding")
    run = search or exact_search(getattr(embedder, "dim", None))
    return run(spark, index, qv, k).withColumnRenamed("id", "key")


def attach_payload(spark: SparkSession, hits: DataFrame, index: DataFrame, n_queries: int, k: int) -> DataFrame:
    """Join hits to document and metadata.  ``hits`` has at most
    ``n_queries * k`` rows; when that is under the broadcast bound it is
    broadcast and the index is streamed (no shuffle of the index)."""
    payload = index.select("key", "document", F.col("meta.title").alias("title"),
                           F.col("meta.question_score").alias("question_score"))
    small = F.broadcast(hits) if n_queries * k * HIT_ROW_BYTES <= broadcast_limit(spark) else hits
    return small.join(payload, "key", "inner")


def ask(spark: SparkSession, questions: DataFrame, index: DataFrame, embedder=None, k: int = rag.TOP_K,
        generator_factory=None, active_models: list[str] | None = None,
        primary: str = rag.PRIMARY_MODEL, search=None, generator_key: str | None = None) -> dict[str, DataFrame]:
    """Returns the intermediate frames (``hits``, ``context``, ``requests``) and
    the final ``answers`` table.  ``search`` picks retrieval: exact by default,
    or :func:`ivf_searcher` over a clustered index."""
    emb = embedder or HashingEmbedder()
    ok, quarantined = split_questions(questions)
    n_ok = ok.count()
    hits = retrieve(spark, ok, index, emb, k, search)
    full = attach_payload(spark, hits, index, n_ok, k)
    ctx = rag.assemble_context(full.withColumnRenamed("key", "doc_key"))
    active = (F.array(*[F.lit(m) for m in active_models]) if active_models
              else F.array().cast("array<string>"))
    req = (ok.drop("status").join(ctx, "query_id", "left")
           .withColumn("context", F.coalesce("context", F.lit("")))
           .withColumn("sources", F.coalesce("sources", F.array().cast("array<string>")))
           .withColumn("docs_actual", F.coalesce("docs_actual", F.lit(0).cast("long")))
           .withColumn("messages", rag.prompt_messages(F.col("q"), F.col("context")))
           .withColumn("candidates", rag.candidate_order(rag.start_model(active, primary), active, primary)))
    kept = ("query_id", "question", "sources", "docs_actual")
    if generator_factory is None:        # the offline default needs no Python and no prompt parsing
        gen = rag.extractive_answers(req, keep=kept)
    else:
        gen = rag.generate(req, generator_factory, keep=kept, cache_key=generator_key)
    answered = gen.select(
        "query_id", "question", "answer", "sources", "model",
        F.lit(k).cast("long").alias("docs_retrieved"), "docs_actual",
        "status", "error", "latency_s")
    rejected = quarantined.select(
        "query_id", "question", F.lit(None).cast("string").alias("answer"),
        F.lit(None).cast("array<string>").alias("sources"), F.lit(None).cast("string").alias("model"),
        F.lit(k).cast("long").alias("docs_retrieved"), F.lit(0).cast("long").alias("docs_actual"),
        "status", F.lit(None).cast("string").alias("error"), F.lit(None).cast("double").alias("latency_s"))
    answers = answered.unionByName(rejected)
    return {"hits": full, "context": ctx, "requests": req, "answers": answers}
