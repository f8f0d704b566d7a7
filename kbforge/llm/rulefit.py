"""Quality classifier as a sparse ensemble of rules (operator 9).

Shallow boosted trees over document statistics are cut into conjunctive rules, one
per node; a lasso logistic regression (proximal gradient, in numpy) keeps few of
them, and what is left becomes a Spark column expression: intercept plus the
weights of the rules that hold, through the logistic function.

Null text is the empty text, scored by its statistics (all 0).  Without usable
labels of both kinds the score is 0.5 for every row.  A score of exactly the threshold
counts as good.  Of several texts under one labelled doc_id the one with the smallest
statistics is learned from.  Columns of any name are kept.  Repeated rows are scored
separately, null ids are kept.  An empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kbforge.llm.common import held_out
from kbforge.llm.docstats import RATIOS, measure
from kbforge.llm.gbt_quality import statistics, training_table
from kbforge.llm.trees import Tree, boost, sigmoid

MAX_ROWS = 20_000
THRESHOLD = 0.3

Rule = tuple[tuple[int, bool, float], ...]     # (feature, value is <= cut, cut), all must hold


@dataclass
class RuleModel:
    intercept: float
    rules: list[Rule]
    weights: list[float]


def tree_rules(tree: Tree) -> list[Rule]:
    """The path to every node but the root, with one bound per feature and side."""
    out = []

    def walk(node: int, bounds: dict) -> None:
        if bounds:
            out.append(tuple(sorted((f, left, cut) for (f, left), cut in bounds.items())))
        if tree.left[node] == node:
            return
        f, cut = int(tree.feature[node]), float(tree.threshold[node])
        walk(int(tree.left[node]), bounds | {(f, True): min(cut, bounds.get((f, True), np.inf))})
        walk(int(tree.right[node]), bounds | {(f, False): max(cut, bounds.get((f, False), -np.inf))})

    walk(0, {})
    return out


def holds(rules: list[Rule], x: np.ndarray) -> np.ndarray:
    """Matrix of 0/1: row satisfies rule."""
    out = np.ones((len(x), len(rules)))
    for k, rule in enumerate(rules):
        for f, left, cut in rule:
            out[:, k] *= (x[:, f] <= cut) if left else (x[:, f] > cut)
    return out


def lasso_logistic(a: np.ndarray, y: np.ndarray, penalty: float, steps: int = 400) -> tuple[float, np.ndarray]:
    """Minimum of mean log loss + penalty * sum |w| (intercept free), by accelerated proximal steps."""
    n = len(y)
    prior = min(max(float(y.mean()), 1e-3), 1 - 1e-3)
    b, w = float(np.log(prior / (1 - prior))), np.zeros(a.shape[1])
    full = np.column_stack([np.ones(n), a])
    # largest eigenvalue of full' full / 4n by power iteration bounds the gradient's slope
    v = np.ones(full.shape[1])
    for _ in range(30):
        v = full.T @ (full @ v)
        v /= np.linalg.norm(v)
    step = 1.0 / max(1e-9, 1.05 * float(np.linalg.norm(full @ v) ** 2) / (4 * n))
    at = look = np.concatenate([[b], w])
    t = 1.0
    for _ in range(steps):
        grad = full.T @ (sigmoid(full @ look) - y) / n
        new = look - step * grad
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - step * penalty, 0)
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        look = new + (t - 1) / t_new * (new - at)
        at, t = new, t_new
    return float(at[0]), at[1:]


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 24, depth: int = 3, penalty: float = 2e-3) -> RuleModel | None:
    if len(np.unique(y)) < 2:
        return None
    trees = boost(x, y, rounds, depth, rate=0.3, row_share=0.5, feature_share=0.6).trees
    rules = list(dict.fromkeys(r for t in trees for r in tree_rules(t)))
    a = holds(rules, x)
    share = a.mean(axis=0)
    use = [k for k in np.flatnonzero((share > 0.002) & (share < 0.998))]
    if not use:
        return RuleModel(float(np.log(y.mean() / (1 - y.mean()))), [], [])
    intercept, w = lasso_logistic(a[:, use], y, penalty)
    return RuleModel(intercept, [rules[k] for k, v in zip(use, w, strict=True) if abs(v) > 1e-6],
                     [float(v) for v in w if abs(v) > 1e-6])


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> RuleModel | None:
    return fit(*training_table(docs, labels, "quality", max_rows))


def score_column(model: RuleModel | None, stat) -> Column:
    """The model as a column; ``stat`` gives the column of a statistic's name."""
    if model is None:
        return F.lit(0.5)
    z = F.lit(model.intercept)
    for rule, weight in zip(model.rules, model.weights, strict=True):
        all_hold = None
        for f, left, cut in rule:
            c = stat(RATIOS[f]) <= F.lit(cut) if left else stat(RATIOS[f]) > F.lit(cut)
            all_hold = c if all_hold is None else all_hold & c
        z = z + F.when(all_hold, F.lit(weight)).otherwise(F.lit(0.0))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def scores(docs: DataFrame, model: RuleModel | None, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row."""
    score = score_column(model, F.col)
    return (statistics(docs).select("doc_id", held_out(5, 0).alias("held_out"), score.alias("score"))
            .withColumn("predicted", (F.col("score") >= threshold).cast("int")))


def keep_good(docs: DataFrame, model: RuleModel | None, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns, whose score reaches ``threshold``."""
    @F.pandas_udf(", ".join(f"{c} double" for c in RATIOS))
    def stats(text: pd.Series) -> pd.DataFrame:
        n = len(RATIOS)
        return pd.DataFrame([measure(t)[-n:] for t in text], columns=list(RATIOS), dtype=float)

    made = "__rulefit_stats"
    while made.lower() in {c.lower() for c in docs.columns}:
        made += "_"
    return (docs.withColumn(made, stats(F.coalesce("text", F.lit(""))))
            .where(score_column(model, lambda name: F.col(made)[name]) >= threshold).drop(made))
