"""Relational steps of the curate job (filters, joins, best-child, top-N, de-dup).

All are plain DataFrame operators; the notes say which physical plan each one
is meant to get and why it survives a hot key.
"""

from __future__ import annotations

from functools import reduce
from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import META_TITLE_CUT

# Quality thresholds of the curate job (strictly greater than).
MIN_ANSWER_CHARS = 50
MIN_QUESTION_CHARS = 20
MIN_TITLE_CHARS = 5


def tag_ids(tags: DataFrame, tag: str, id_col: str = "Id", tag_col: str = "Tag") -> DataFrame:
    """FLT-1: ids carrying ``tag`` (exact, case-sensitive), one row per id.

    ``distinct`` is a partial + final hash aggregate: a hot id is combined map-side.
    """
    return tags.where(F.col(tag_col) == F.lit(tag)).select(id_col).distinct()


def semi_join(df: DataFrame, keys: DataFrame, left_key: str, right_key: str | None = None) -> DataFrame:
    """JOIN-1 / JOIN-2: keep rows of ``df`` whose key is in ``keys``.

    No hint: AQE broadcasts ``keys`` at runtime when its measured size is under
    ``spark.sql.autoBroadcastJoinThreshold`` and otherwise keeps a shuffled join,
    so an unbounded key set never goes through one task.
    """
    right_key = right_key or left_key
    k = keys.select(F.col(right_key).alias("_k"))
    return df.join(k, df[left_key] == k["_k"], "left_semi")


def bounded_semi_join(df: DataFrame, keys: DataFrame, left_key: str, right_key: str | None = None) -> DataFrame:
    """JOIN-2 when ``keys`` is the output of a top-N: its size is bounded by N,
    so it is broadcast explicitly (proven bound) and ``df`` is never shuffled."""
    right_key = right_key or left_key
    k = keys.select(F.col(right_key).alias("_k"))
    return df.join(F.broadcast(k), df[left_key] == k["_k"], "left_semi")


def top_n(df: DataFrame, n: int, score: str = "Score", tiebreak: str = "Id") -> DataFrame:
    """TOP-1: top ``n`` rows by score descending, nulls last, ties by id.

    Planned as TakeOrderedAndProject: each task keeps its own top n, one task
    merges at most n x tasks rows.
    """
    return df.orderBy(F.col(score).desc_nulls_last(), F.col(tiebreak).asc()).limit(n)


def _null_last_key(score: Column, tiebreaks: Sequence[Column]) -> Column:
    """Orderable key: any score beats a null score; higher score first; lower ids first."""
    return F.struct(score.isNotNull().alias("has"), F.coalesce(score.cast("double"), F.lit(0.0)).alias("s"),
                    *[(-t.cast("long")).alias(f"t{i}") for i, t in enumerate(tiebreaks)])


def best_child(df: DataFrame, parent: str, score: str, tiebreak: str | Sequence[str],
               value_cols: Sequence[str], mode: str = "column") -> DataFrame:
    """AGG-1 / AGG-2: best child per parent by score (desc, nulls last, ties by id).

    ``mode='column'`` reproduces first-non-null-per-column: every value column
    takes the value of the best row *among rows where that column is not null*.
    ``mode='row'`` keeps one whole source row.

    Both are ``max_by`` aggregates: partial aggregation runs before the shuffle,
    so a parent holding a third of all children still reduces to one row per
    task before anything moves.  Rows with a null parent are dropped.
    """
    src = df.where(F.col(parent).isNotNull())
    ties = [tiebreak] if isinstance(tiebreak, str) else list(tiebreak)
    key = _null_last_key(F.col(score), [F.col(t) for t in ties])
    if mode == "column":
        aggs = [F.max_by(F.col(c), F.when(F.col(c).isNotNull(), key)).alias(c)
                for c in [score, *value_cols]]
        return src.groupBy(parent).agg(*aggs)
    if mode == "row":
        cols = list(dict.fromkeys([score, *ties, *value_cols]))
        row = F.struct(*[F.col(c) for c in cols])
        g = src.groupBy(parent).agg(F.max_by(row, key).alias("_best"))
        return g.select(parent, *[F.col(f"_best.{c}").alias(c) for c in cols])
    raise ValueError(f"unknown mode {mode!r}")


def equi_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str,
              how: str = "inner") -> DataFrame:
    """JOIN-3: equi-join on differently named keys; unmatched rows drop (inner)."""
    return left.join(right, left[left_key] == right[right_key], how)


def quality_filter(df: DataFrame, answer: str = "answer_body", question: str = "question_body",
                   title: str = "title", min_answer: int = MIN_ANSWER_CHARS,
                   min_question: int = MIN_QUESTION_CHARS, min_title: int = MIN_TITLE_CHARS) -> DataFrame:
    """FLT-2: length(answer) > 50, length(question) > 20, length(title) > 5.
    A null length fails (comparison with null is not true)."""
    return df.where((F.length(answer) > min_answer) & (F.length(question) > min_question)
                    & (F.length(title) > min_title))


def dedupe_by_key(df: DataFrame, key: str, order: Sequence[Column]) -> DataFrame:
    """SET-2: one row per key, the first by ``order``.

    ``row_number() = 1`` lets Spark insert a partial WindowGroupLimit before the
    exchange, so each task forwards at most one row per key.
    """
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def rename_clean_qa(df: DataFrame) -> DataFrame:
    """PRJ-1: the six output columns with their fixed names."""
    return df.select(
        F.col("Id").cast("long").alias("question_id"),
        F.col("Title").alias("title"),
        F.col("CleanBody").alias("question_body"),
        F.col("Score").cast("long").alias("question_score"),
        F.col("CleanAnswer").alias("answer_body"),
        F.col("AnswerScore").cast("long").alias("answer_score"),
    )


def metadata_record(title: Column, question_score: Column, answer_score: Column,
                    title_cut: int = META_TITLE_CUT) -> Column:
    """PRJ-2: metadata struct stored with each vector (title cut to 200)."""
    return F.struct(F.substring(title, 1, title_cut).alias("title"),
                    question_score.cast("int").alias("question_score"),
                    answer_score.cast("int").alias("answer_score"))


def union_parts(parts: Sequence[DataFrame]) -> DataFrame:
    """SET-1: concatenate inputs of one schema (by column name)."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def first_seen_distinct(df: DataFrame, group: str, value: Column, order: Sequence[Column],
                        out: str = "values") -> DataFrame:
    """SET-3: per group, distinct non-empty values in order of first appearance.

    First appearance is a partial ``min`` per (group, value) — bounded by the
    number of distinct values — before any list is built, so a group holding a
    third of all rows never becomes one in-memory list of its rows.
    """
    firsts = (df.where(value.isNotNull() & (value != ""))
              .groupBy(F.col(group), value.alias("_v"))
              .agg(F.min(F.struct(*order)).alias("_first")))
    lists = firsts.groupBy(group).agg(
        F.array_sort(F.collect_list(F.struct(F.col("_first"), F.col("_v")))).alias("_l"))
    return lists.select(group, F.transform("_l", lambda x: x["_v"]).alias(out))


def funnel(stages: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """AGG-3: (step_no, step, rows) for each named stage of a job."""
    parts = [df.agg(F.count(F.lit(1)).alias("rows"))
             .select(F.lit(i + 1).cast("long").alias("step_no"), F.lit(name).alias("step"), "rows")
             for i, (name, df) in enumerate(stages)]
    return union_parts(parts)
