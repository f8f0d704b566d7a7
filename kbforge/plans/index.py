"""Index job: curated pairs -> document strings -> vectors -> collection records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import doc_template
from ..functions.vectors import HashingEmbedder
from ..operators.relational import metadata_record


def qa_documents(pairs: DataFrame, q_cut: int | None = None, a_cut: int | None = None) -> DataFrame:
    """STR-4 + PRJ-2: one record per curated pair (key, id, document, meta).

    The whole question and answer are indexed; cuts are for rendering only.
    """
    return pairs.select(
        F.col("question_id").cast("long").alias("key"),
        F.col("question_id").cast("string").alias("id"),
        doc_template(F.col("title"), F.col("question_body"), F.col("answer_body"), q_cut, a_cut).alias("document"),
        metadata_record(F.col("title"), F.col("question_score"), F.col("answer_score")).alias("meta"),
    )


def qa_records(pairs: DataFrame, embedder=None) -> DataFrame:
    """VEC-1: documents with their embedding (same embedder as for questions)."""
    emb = embedder or HashingEmbedder()
    return emb.embed(qa_documents(pairs), "document", "embedding")
