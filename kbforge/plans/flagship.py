"""Flagship queries: curate conversations, index them, answer every user turn.

Every query reads whole shared tables (or data Spark derives from them) and
returns a DataFrame whose column names and types match the oracle SQL.  Numeric
results that involve floating-point sums are rounded in both.  List results are
rendered as strings (``' || '``-joined) so both engines hash the same values.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import HashingEmbedder, DEFAULT_DIM
from ..operators import rag
from . import adapters as A
from . import sqltext as S
from .ask import ask
from .curate import curate, DEFAULT_TOP_N
from .index import qa_records
from ..operators.collection import build_collection, open_collection
from ..session import checkpoint_dir, code_digest, input_fingerprint

from .registry import LIST_SEP, REGISTRY, register  # noqa: F401


# =====================================================================================
# Flagship: curate conversations -> index -> answer every user turn (RAG-7 / RAG-8)
# =====================================================================================
# question id = conv_id * 2^20 + turn; a turn number that does not fit fails the job
TURN_BITS = 20
QUESTION_KEY = f"conv_id * {1 << TURN_BITS} + turn"


def conversation_questions(spark: SparkSession, sf: str) -> DataFrame:
    conv = A.table(spark, sf, "conversations")
    turn = F.when((F.col("turn") < 0) | (F.col("turn") >= (1 << TURN_BITS)),
                  F.raise_error(F.lit("turn number out of range for the question key")).cast("long")
                  ).otherwise(F.col("turn"))
    return conv.where(F.col("role") == "user").select(
        (F.col("conv_id") * (1 << TURN_BITS) + turn).cast("long").alias("query_id"),
        F.col("text").alias("question"))


def curated_pairs(spark: SparkSession, sf: str, tag: str | None = None, top_n: int | None = None):
    return curate(A.qa_questions(spark, sf), A.qa_answers(spark, sf), A.qa_tags(spark, sf), tag, top_n)


def flagship_index(spark: SparkSession, sf: str) -> DataFrame:
    """Curate + index, committed once as a collection (VEC-5) under the session's
    checkpoint folder and reused while the input files are unchanged (build mode
    ``skip``, keyed by a fingerprint of the inputs, the settings and the code); the ask job reads it."""
    # spark.kbforge.reuseIndex=false forces a fresh build (bench.py measures curate + index + ask)
    reuse = spark.conf.get("spark.kbforge.reuseIndex", "true").lower() != "false"
    digest = input_fingerprint(spark, [f"{sf.rstrip('/')}/conversations.parquet"])
    settings = f"dim={DEFAULT_DIM},top_n=None,tag=None"
    key = hashlib.sha1(f"{digest}|{settings}|{code_digest()}".encode()).hexdigest()[:20]
    if not reuse:
        key = f"{key}-{uuid.uuid4().hex[:8]}"
    path = f"{checkpoint_dir(spark).rstrip('/')}/kbforge-collections/qa-{key}"
    records = qa_records(curated_pairs(spark, sf).pairs, HashingEmbedder(DEFAULT_DIM))
    build_collection(spark, records, path, name="qa_pairs", mode="skip" if reuse else "rebuild")
    return open_collection(spark, path)


def flagship_answers(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    return ask(spark, conversation_questions(spark, sf), flagship_index(spark, sf), HashingEmbedder(DEFAULT_DIM))


def _sql_pairs(tag: str | None = None, top_n: int | None = DEFAULT_TOP_N) -> str:
    """CTE chain ending in ``pairs`` (the curated six columns) over the qa_* CTEs."""
    tagged = (f"qs AS (SELECT * FROM qa_questions WHERE Id IN (SELECT DISTINCT Id FROM qa_tags WHERE Tag = {S.q(tag)})), "
              if tag is not None else "qs AS (SELECT * FROM qa_questions), ")
    return (
        tagged +
        ("topq AS (SELECT * FROM qs), " if top_n is None else
         f"topq AS (SELECT * FROM qs ORDER BY Score DESC NULLS LAST, Id LIMIT {top_n}), ") +
        "ans AS (SELECT * FROM qa_answers WHERE ParentId IN (SELECT Id FROM topq)), "
        "best AS (SELECT ParentId AS QuestionId, "
        "  arg_max(Body, (Score IS NOT NULL, coalesce(CAST(Score AS DOUBLE), 0.0), -Id)) AS AnswerBody, "
        "  max(Score) AS AnswerScore FROM ans WHERE ParentId IS NOT NULL GROUP BY ParentId), "
        f"pairs0 AS (SELECT CAST(q.Id AS BIGINT) AS question_id, q.Title AS title, {S.clean_html('q.Body')} AS question_body, "
        f"  CAST(q.Score AS BIGINT) AS question_score, {S.clean_html('b.AnswerBody')} AS answer_body, "
        "  CAST(b.AnswerScore AS BIGINT) AS answer_score FROM topq q JOIN best b ON q.Id = b.QuestionId), "
        "pairs1 AS (SELECT * FROM pairs0 WHERE length(answer_body) > 50 AND length(question_body) > 20 AND length(title) > 5), "
        "pairs AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY question_id "
        "  ORDER BY question_score DESC NULLS LAST, answer_score DESC NULLS LAST, answer_body ASC NULLS LAST) AS rn "
        "  FROM pairs1) WHERE rn = 1)"
    )


def _sql_flagship_ctes(k: int = rag.TOP_K) -> str:
    nl2 = f"{S.NL} || {S.NL}"
    return A.sql_with_qa("SELECT 1").replace(" SELECT 1", "") + ", " + _sql_pairs(top_n=None) + ", " + (
        f"docs AS (SELECT question_id AS key, 'Q: ' || title || {S.NL} || question_body || {nl2} || 'A: ' "
        f"  || answer_body AS document, left(title, 200) AS mtitle, CAST(question_score AS INTEGER) AS mscore FROM pairs), "
        f"questions AS (SELECT CAST({QUESTION_KEY} AS BIGINT) AS query_id, text AS question FROM conversations WHERE role = 'user'), "
        f"val AS (SELECT query_id, question, {S.validate('question')} AS status, {S.py_strip('question')} AS q FROM questions), "
        "okq AS (SELECT query_id, q FROM val WHERE status = 'ok'), "
        + S.sparse_vectors("d", "docs", "key", "document", DEFAULT_DIM) + ", "
        + S.sparse_vectors("qq", "okq", "query_id", "q", DEFAULT_DIM) + ", "
        + S.knn_sparse("qq", "d", k) + ", "
        f"parts AS (SELECT h.query_id, h.rank, h.distance, '--- {rag.RESULT_LABEL} ' || h.rank || ' ---' || {S.NL} || 'Title: ' "
        f"  || coalesce(d.mtitle, 'Unknown') || ' (votes: ' || coalesce(d.mscore, 0) || ')' || {S.NL} || 'Relevance: ' "
        f"  || {S.fixed1('(1.0 - h.distance) * 100.0')} || '%' || {nl2} || d.document AS part, "
        "  coalesce(d.mtitle, 'Unknown') AS title, d.document FROM hits h JOIN docs d USING (key)), "
        f"ctx AS (SELECT query_id, string_agg(part, {nl2} ORDER BY rank) AS context, "
        f"  string_agg(title, {S.q(LIST_SEP)} ORDER BY rank) AS sources, CAST(count(*) AS BIGINT) AS docs_actual, "
        f"  arg_min(document, rank) AS top_doc FROM parts GROUP BY query_id)"
    )


def _answers_out(res: dict[str, DataFrame]) -> DataFrame:
    a = res["answers"]
    return a.select("query_id", "question", "status", "answer",
                    F.array_join("sources", LIST_SEP).alias("sources"), "model",
                    "docs_retrieved", "docs_actual")


SQL_RAG_ANSWERS = "WITH " + _sql_flagship_ctes()[len("WITH "):] + f"""
SELECT v.query_id, v.question,
       CASE WHEN v.status = 'ok' THEN 'answered' ELSE v.status END AS status,
       CASE WHEN v.status = 'ok' THEN coalesce(
            CASE WHEN strpos(c.top_doc, {S.NL} || {S.NL} || 'A: ') > 0
                 THEN substr(c.top_doc, strpos(c.top_doc, {S.NL} || {S.NL} || 'A: ') + 5) ELSE c.top_doc END, '') END AS answer,
       CASE WHEN v.status = 'ok' THEN coalesce(c.sources, '') END AS sources,
       CASE WHEN v.status = 'ok' THEN {S.q(rag.PRIMARY_MODEL)} END AS model,
       CAST({rag.TOP_K} AS BIGINT) AS docs_retrieved,
       CASE WHEN v.status = 'ok' THEN coalesce(c.docs_actual, 0) ELSE 0 END AS docs_actual
FROM val v LEFT JOIN ctx c USING (query_id)
"""


@register("rag_ask_answers", SQL_RAG_ANSWERS)
def q_rag_answers(spark: SparkSession, sf: str) -> DataFrame:
    """RAG-7 / RAG-6 / RAG-5 (extractive) end to end."""
    return _answers_out(flagship_answers(spark, sf))


@register("rag_retrieve_hits", "WITH " + _sql_flagship_ctes()[len("WITH "):] +
          " SELECT query_id, CAST(rank AS BIGINT) AS rank, CAST(key AS BIGINT) AS doc_key, round(distance, 6) AS distance FROM hits")
def q_rag_hits(spark: SparkSession, sf: str) -> DataFrame:
    """VEC-1 + VEC-3 + WIN-1 + TOP-2 on the curated conversation index."""
    h = flagship_answers(spark, sf)["hits"]
    return h.select("query_id", F.col("rank").cast("long").alias("rank"), F.col("key").alias("doc_key"),
                    F.round("distance", 6).alias("distance"))


@register("rag_context_block", "WITH " + _sql_flagship_ctes()[len("WITH "):] +
          " SELECT query_id, context, sources, docs_actual FROM ctx")
def q_rag_context(spark: SparkSession, sf: str) -> DataFrame:
    """RAG-1 + AGG-5 + AGG-6 + STR-6 + STR-9."""
    c = flagship_answers(spark, sf)["context"]
    return c.select("query_id", "context", F.array_join("sources", LIST_SEP).alias("sources"), "docs_actual")



IVF_CLUSTERS = 4


@register("rag_ask_answers_ivf", SQL_RAG_ANSWERS)
def q_rag_answers_ivf(spark: SparkSession, sf: str) -> DataFrame:
    """RAG-7 with retrieval through the clustered index (VEC-4), all clusters
    probed, and generation calls (RAG-5): answers must equal the exact flagship."""
    from ..operators.ivf import build_ivf
    from .ask import ivf_searcher
    index = flagship_index(spark, sf)
    ivf = build_ivf(index, IVF_CLUSTERS, id_col="key", vec_col="embedding")
    res = ask(spark, conversation_questions(spark, sf), index, HashingEmbedder(DEFAULT_DIM),
              search=ivf_searcher(ivf, nprobe=IVF_CLUSTERS), generator_factory=rag._extractive_factory)
    return _answers_out(res)
