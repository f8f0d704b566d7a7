"""RAG-8: curate raw questions / answers / tags into clean question-answer pairs.

Order of steps matters and is kept: tag filter -> questions semi join -> top-N by
score -> answers of those N -> best answer per question -> HTML cleaning (only on
survivors) -> inner join -> rename -> quality filters -> de-duplicate.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.html import clean_html
from ..operators import relational as R
from ..session import broadcast_limit, checkpoint_dir

# Fixed value: number of top-scored questions kept before the quality filters.
DEFAULT_TOP_N = 15000


@dataclass
class CurateResult:
    pairs: DataFrame
    stages: list  # (name, DataFrame) for the funnel report (AGG-3)
    observations: dict = field(default_factory=dict)  # name -> Observation (observe=True)

    def observed_funnel(self) -> list[tuple[int, str, int]]:
        """AGG-3 from the metrics gathered while ``pairs`` was computed (one pass)."""
        names = [n for n, _ in self.stages if n in self.observations]
        return [(i + 1, n, int(self.observations[n].get["rows"])) for i, n in enumerate(names)]


def curate(questions: DataFrame, answers: DataFrame, tags: DataFrame, tag: str | None,
           top_n: int | None = DEFAULT_TOP_N, answer_mode: str = "column", observe: bool = False) -> CurateResult:
    """Inputs use the raw column names Id/Title/Body/Score, ParentId/Body/Score/Id, Id/Tag.

    ``top_n=None`` keeps every question (no TOP-1 and no JOIN-2 restriction).
    ``tag=None`` skips the tag filter (FLT-1 + JOIN-1).  ``observe=True`` attaches
    a row-count ``Observation`` to each stage, so the funnel (AGG-3) is gathered
    while the pairs are computed once (see :func:`write_curated`).
    """
    stages = []
    observations: dict = {}
    run = uuid.uuid4().hex[:8]

    def mark(name: str, df: DataFrame) -> DataFrame:
        if not observe:
            return df
        o = Observation(f"curate_{name}_{run}")
        observations[name] = o
        return df.observe(o, F.count(F.lit(1)).alias("rows"))

    if tag is not None:
        ids = R.tag_ids(tags, tag)                                   # FLT-1
        stages.append(("tagged_ids", ids))
        qs = R.semi_join(questions, mark("tagged_ids", ids), "Id")   # JOIN-1
    else:
        qs = questions
    stages.append(("questions", qs))
    if top_n is None:
        return _finish(qs, answers, stages, observations, mark, answer_mode)
    parts = max(1, min(top_n // 100, questions.sparkSession.sparkContext.defaultParallelism))
    # TOP-1 runs once: its result (at most N rows) is checkpointed into the shared
    # checkpoint folder and read by both the question side and the JOIN-2 keys,
    # so the full question input is scanned once.  The repartition keeps the
    # per-task top-N heap (TakeOrderedAndProject) and spreads later cleaning.
    checkpoint_dir(questions.sparkSession)
    top = R.top_n(mark("questions", qs), top_n, "Score", "Id").repartition(parts, "Id").checkpoint(eager=True)
    stages.append(("top_questions", top))
    top_keys = top.select("Id")
    top = mark("top_questions", top)
    # JOIN-2: N keys are broadcast when N x 16 bytes is under the broadcast bound
    if top_n * 16 <= broadcast_limit(questions.sparkSession):
        ans = R.bounded_semi_join(answers, top_keys, "ParentId", "Id")
    else:
        ans = R.semi_join(answers, top_keys, "ParentId", "Id")
    stages.append(("answers", ans))
    return _finish(top, ans, stages, observations, mark, answer_mode)


def _finish(top: DataFrame, ans: DataFrame, stages: list, observations: dict, mark, answer_mode: str) -> CurateResult:
    """Best answer per question, cleaning, join, filters and one row per question."""
    best = R.best_child(mark("answers", ans), "ParentId", "Score", "Id", ["Body"], mode=answer_mode)   # AGG-1/2
    best = best.select(F.col("ParentId").alias("QuestionId"),
                       clean_html(F.col("Body")).alias("CleanAnswer"),             # STR-1
                       F.col("Score").alias("AnswerScore"))
    stages.append(("best_answers", best))
    best = mark("best_answers", best)
    qclean = top.select("Id", "Title", "Score", clean_html(F.col("Body")).alias("CleanBody"))
    merged = R.equi_join(qclean, best, "Id", "QuestionId")           # JOIN-3
    out = R.rename_clean_qa(merged)                                  # PRJ-1
    out = R.quality_filter(out)                                      # FLT-2
    out = R.dedupe_by_key(out, "question_id",                        # SET-2
                          [F.col("question_score").desc_nulls_last(), F.col("answer_score").desc_nulls_last(),
                           F.col("answer_body").asc_nulls_last()])
    stages.append(("final", out))
    return CurateResult(out, stages, observations)


def write_curated(result: CurateResult, path: str) -> list[tuple[int, str, int]]:
    """SNK-1 plus AGG-3 in one pass: write the pairs, return the observed funnel
    (requires ``curate(..., observe=True)``).

    The final count is observed above the sink's global sort: the sort samples
    its input in a separate job, which would otherwise count the last stage twice.
    """
    from ..sources.tables import CLEAN_QA_COLUMNS
    o = Observation(f"curate_final_{uuid.uuid4().hex[:8]}")
    (result.pairs.select(*CLEAN_QA_COLUMNS)
     .orderBy(F.col("question_score").desc_nulls_last(), F.col("question_id"))
     .observe(o, F.count(F.lit(1)).alias("rows"))
     .write.mode("overwrite").parquet(path))
    result.observations["final"] = o
    return result.observed_funnel()
