"""Quality rules plus gradient-boosted trees with monotonic constraints (operator 4).

Each text is measured once (see ``docstats``).  The base rules reject texts with
fewer than 20 words or with more than 30 % of words in repeated 8-word windows;
the others are judged by gradient-boosted trees over the ratios, trained in numpy
on at most ``max_rows`` labelled documents and flattened into node arrays that
score a whole batch at once.  More symbols, repeated lines, repeated windows, bars
or exclamation marks can never raise a score.

Null text is the empty text (no words: base_failed).  Without usable labels of
both kinds there is no model and every document that passes the base rules is
kept.  A score of exactly ``keep_score`` keeps.  Of several texts under one labelled
doc_id the one with the smallest ratios is learned from.  Repeated rows are scored separately, null ids are kept.  An empty table
gives an empty result.  Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kbforge.llm.common import id_and_text, map_batches, training_ids
from kbforge.llm.docstats import ALL, COUNTS, RATIOS, measure
from kbforge.llm.trees import Boosted, boost

MAX_ROWS = 20_000
KEEP_SCORE = 0.3
# fixed: the sign of each constrained ratio's effect on the quality score
MONOTONE = {"symbols_per_word": -1, "dup_line_share": -1, "repeat_word_share": -1, "bang_share": -1, "pipe_share": -1}

STATS = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", " + ", ".join(f"{c} double" for c in RATIOS)


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id and every statistic of its text."""
    def run(batch: pa.RecordBatch) -> dict:
        rows = [measure(t.as_py()) for t in batch.column(1)]
        return {"doc_id": batch.column(0)} | dict(zip(ALL, zip(*rows, strict=True), strict=True))

    return map_batches(id_and_text(docs), run, STATS)


def training_table(docs: DataFrame, labels: DataFrame, label: str, max_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Ratios and 0/1 labels of at most ``max_rows`` documents outside the held-out fold."""
    chosen = training_ids(labels, label, 5, 0, max_rows)
    # one row a doc_id, so at most max_rows come to the driver
    rows = (statistics(docs.join(F.broadcast(chosen.select("doc_id")), "doc_id", "left_semi"))
            .groupBy("doc_id").agg(F.min(F.struct(*RATIOS)).alias("r")).select("doc_id", "r.*")
            .join(F.broadcast(chosen), "doc_id").orderBy("doc_id").toPandas())
    return rows[list(RATIOS)].to_numpy(float), (rows["label"].to_numpy() > 0).astype(float)


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, rounds: int = 60,
          depth: int = 3) -> Boosted | None:
    x, y = training_table(docs, labels, "quality", max_rows)
    if len(np.unique(y)) < 2:
        return None
    signs = {RATIOS.index(name): sign for name, sign in MONOTONE.items()}
    return boost(x, y, rounds, depth, monotone=signs)


def verdicts(docs: DataFrame, model: Boosted | None, keep_score: float = KEEP_SCORE) -> DataFrame:
    """Counts, base_failed, score and kept of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> dict:
        rows = [measure(t.as_py()) for t in batch.column(1)]
        counts = np.array([r[:len(COUNTS)] for r in rows], np.int64)
        n, rep = counts[:, 0], counts[:, 4]
        failed = (n < 20) | (100 * rep > 30 * n)
        trees = sent.value
        score = trees.score(np.array([r[len(COUNTS):] for r in rows])) if trees else np.ones(len(rows))
        return ({"doc_id": batch.column(0)} | {c: counts[:, k] for k, c in enumerate(COUNTS)}
                | {"base_failed": failed, "score": score, "kept": ~failed & (score >= keep_score)})

    return map_batches(id_and_text(docs), run, "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS)
                       + ", base_failed boolean, score double, kept boolean")
