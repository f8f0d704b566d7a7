"""Toxicity by a factorization machine over hashed terms (operator 6).

A document is the set of its lower-cased words.  A word carries up to four terms,
itself and its beginnings of four, five and six letters, hashed to 24 bits; a
term has a linear weight and a factor vector, and a word's are the sums of its
terms'.  The score is the logistic of

    bias + sum of linear weights + (|sum of factors|^2 - sum of |factors|^2) / 2n

over the n words, so pairs of words (an insult with a group's name) weigh in beside
single ones, also where neither word tells anything alone.  Training is AdaGrad in
numpy on at most ``max_rows`` labelled documents outside the held-out fold, and
on at most ``max_words`` different words of each (those of the smallest hash).  Every term
in at least ``min_docs`` of them takes part, with a linear weight and with factors.
What they do not earn is taken from them while they are learned: a lasso step
shrinks linear weights and a group lasso step whole factor vectors, so rare words of
single documents are not learned by heart and most terms end with neither.  Whole
texts are scored.

Null text is the empty text; it and texts without words score the logistic of the
bias.  Without any usable label every score is 0.  A score of exactly the threshold
is toxic.  Of several texts under one labelled doc_id one is learned from, that with the
smallest hash.  Repeated rows are scored separately, null ids are kept.  An empty
table gives an empty result.  Other columns are not read.
"""

from __future__ import annotations

import re
import uuid
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kbforge.llm.common import held_out, id_and_text, map_batches, training_ids
from kbforge.llm.trees import sigmoid

MAX_ROWS = 10_000
MAX_WORDS = 3_000
TERMS = 4
STEMS = (4, 5, 6)
SPACE = 1 << 24
_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> set[str]:
    return set(_WORD.findall(text.lower()))


def terms(word: str) -> list[int]:
    """Hashed terms of a word, 1 or more each; 0 fills up to ``TERMS``."""
    out = [zlib.crc32(word.encode("utf-8", "surrogatepass")) % (SPACE - 1) + 1]
    for n in STEMS:
        out.append(zlib.crc32(word[:n].encode("utf-8", "surrogatepass"), n) % (SPACE - 1) + 1 if len(word) > n else 0)
    return out


def common_terms(docs: list[np.ndarray], min_docs: int) -> np.ndarray:
    """Sorted terms that at least ``min_docs`` of the documents have."""
    sets = [np.unique(d) for d in docs] or [np.zeros(0, np.int64)]
    every, count = np.unique(np.concatenate(sets), return_counts=True)
    return every[(count >= min_docs) & (every > 0)]


def _places(kept: np.ndarray, found: np.ndarray) -> np.ndarray:
    """Row of each term: its place in ``kept`` plus 1, or 0."""
    if not len(kept):
        return np.zeros_like(found)
    at = np.minimum(np.searchsorted(kept, found), len(kept) - 1)
    return np.where(kept[at] == found, at + 1, 0)


@dataclass
class Machine:
    bias: float
    term: dict[int, int]         # hashed term -> row
    linear: np.ndarray
    factors: np.ndarray          # row 0 is zero, for terms without a weight


def fit(docs: list[np.ndarray], y: np.ndarray, rank: int = 4, epochs: int = 20, rate: float = 0.4,
        lasso: float = 7e-4, group_lasso: float = 1e-4, min_docs: int = 4, batch: int = 64, seed: int = 11) -> Machine:
    """``docs``: for each document the terms of its words, one row of ``TERMS`` a word."""
    kept = common_terms(docs, min_docs)
    rows = [_places(kept, d) for d in docs]
    length = np.array([max(1, len(d)) for d in docs])
    # words without a weight add nothing but their number; one empty word stands for a text without others
    empty = np.zeros((1, TERMS), np.int64)
    rows = [r[r.any(axis=1)] if r.any() else empty for r in rows]
    rng = np.random.default_rng(seed)
    linear = np.zeros(len(kept) + 1)
    factors = rng.normal(0, 0.02, (len(kept) + 1, rank))
    factors[0] = 0
    prior = min(max(float(y.mean()), 1e-3), 1 - 1e-3)
    bias = np.array(np.log(prior / (1 - prior)))
    gl, gf, gb = np.full(len(linear), 1e-6), np.full(len(factors), 1e-6), 1e-6
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), batch):
            pick = order[at:at + batch]
            own, n = np.array([len(rows[k]) for k in pick]), length[pick]
            idx = np.concatenate([rows[k] for k in pick])
            start = np.concatenate([[0], np.cumsum(own)[:-1]])
            words = factors[idx].sum(axis=1)
            total = np.add.reduceat(words, start)
            pair = (total ** 2).sum(axis=1) - np.add.reduceat((words ** 2).sum(axis=1), start)
            z = bias + np.add.reduceat(linear[idx].sum(axis=1), start) + pair / (2 * n)
            g = (sigmoid(z) - y[pick]) / len(pick)
            met, flat = np.unique(idx.ravel(), return_inverse=True)      # only terms of the batch move
            d_linear = np.bincount(flat, np.repeat(np.repeat(g, own), TERMS), len(met))
            d_words = np.repeat(g / n, own)[:, None] * (np.repeat(total, own, axis=0) - words)
            d_factors = np.stack([np.bincount(flat, np.repeat(d_words[:, f], TERMS), len(met)) for f in range(rank)], axis=1)
            gl[met] += d_linear ** 2
            gf[met] += (d_factors ** 2).sum(axis=1)
            gb += g.sum() ** 2
            step = rate / np.sqrt(gl[met])
            w = linear[met] - step * d_linear
            linear[met] = np.sign(w) * np.maximum(np.abs(w) - step * lasso, 0)
            step = 0.3 * rate / np.sqrt(gf[met])
            v = factors[met] - step[:, None] * d_factors
            norm = np.sqrt((v ** 2).sum(axis=1))
            factors[met] = v * (np.maximum(norm - step * group_lasso, 0) / np.maximum(norm, 1e-12))[:, None]
            bias = bias - rate * g.sum() / np.sqrt(gb)
            linear[0], factors[0] = 0, 0
    used = np.flatnonzero((linear != 0) | factors.any(axis=1))          # only these are shipped
    at = np.concatenate([[0], used])
    return Machine(float(bias), {int(kept[t - 1]): k + 1 for k, t in enumerate(used)}, linear[at], factors[at])


class Scorer:
    """Scores texts, remembering the rows of recurring words in a bounded dictionary."""

    def __init__(self, model: Machine, max_words: int = 400_000):
        self.model, self.max_words = model, max_words
        self.rows: dict[str, int] = {}
        self.index: dict[tuple, int] = {(0,) * TERMS: 0}
        self._extend()

    def _extend(self) -> None:
        at = np.array(list(self.index), np.int64)
        self.linear = self.model.linear[at].sum(axis=1)
        self.factors = self.model.factors[at].sum(axis=1)

    def _learn(self, words: list[str]) -> None:
        size = len(self.index)
        for w in words:
            key = tuple(self.model.term.get(t, 0) for t in terms(w))
            self.rows[w] = self.index.setdefault(key, len(self.index))
        if len(self.index) > size:
            self._extend_from(size)

    def _extend_from(self, size: int) -> None:
        new = np.array(list(self.index)[size:], np.int64)
        self.linear = np.concatenate([self.linear, self.model.linear[new].sum(axis=1)])
        self.factors = np.concatenate([self.factors, self.model.factors[new].sum(axis=1)])

    def score(self, text: str) -> float:
        words = words_of(text)
        found = [self.rows.get(w, -1) for w in words]
        if -1 in found:
            if len(self.rows) > self.max_words:
                self.rows.clear()
                self.index = {(0,) * TERMS: 0}
                self._extend()
                found = [-1] * len(found)
            self._learn([w for w, f in zip(words, found, strict=True) if f < 0])
            found = [self.rows[w] for w in words]
        z, n = self.model.bias, len(found)
        if n:
            at = np.array(found, np.int64)
            at = np.sort(at[at > 0])                 # a fixed order of summation; row 0 adds nothing
            f = self.factors[at]
            total = f.sum(axis=0)
            z += float(self.linear[at].sum()) + float((total ** 2).sum() - (f ** 2).sum()) / (2 * n)
        return float(sigmoid(np.float64(z)))


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, max_words: int = MAX_WORDS) -> Machine | None:
    chosen = training_ids(labels, "toxic", 5, 0, max_rows)

    def some(text: str) -> list[str]:
        words = words_of(text)
        if len(words) > max_words:
            words = sorted(words, key=lambda w: (zlib.crc32(w.encode("utf-8", "surrogatepass")), w))[:max_words]
        return sorted(words)

    def hashed(batch: pa.RecordBatch) -> dict:
        return {"doc_id": batch.column(0), "terms": [[t for w in some(x.as_py()) for t in terms(w)] for x in batch.column(1)]}

    used = docs.join(F.broadcast(chosen.select("doc_id")), "doc_id", "left_semi")
    # one row a doc_id: at most max_rows come to the driver, of at most max_words words
    table = (map_batches(id_and_text(used), hashed, "doc_id long, terms array<int>")
             .groupBy("doc_id").agg(F.min_by("terms", F.xxhash64("terms")).alias("terms"))
             .join(F.broadcast(chosen), "doc_id").orderBy("doc_id").toArrow())
    if not table.num_rows:
        return None
    # one row of TERMS a word, viewed without making Python objects
    column = table.column("terms").combine_chunks()
    offsets, flat = column.offsets.to_numpy(), column.values.to_numpy()
    rows = [flat[a:b].reshape(-1, TERMS) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    y = (table.column("label").to_numpy() > 0).astype(float)
    return fit(rows, y)


_SCORERS: dict[str, Scorer] = {}


def _scorer(key: str, model: Machine) -> Scorer:
    """The scorer of a model, kept by the worker for its next tasks (a function of the module, so not shipped)."""
    if key not in _SCORERS:
        _SCORERS.clear()
        _SCORERS[key] = Scorer(model)
    return _SCORERS[key]


def scores(docs: DataFrame, model: Machine | None, threshold: float = 0.5) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    key = uuid.uuid4().hex

    def run(batch: pa.RecordBatch) -> dict:
        if sent.value is None:
            return {"doc_id": batch.column(0), "score": [0.0] * batch.num_rows}
        score = _scorer(key, sent.value).score
        return {"doc_id": batch.column(0), "score": [score(t.as_py()) for t in batch.column(1)]}

    return (map_batches(id_and_text(docs), run, "doc_id long, score double")
            .select("doc_id", held_out(5, 0).alias("held_out"), "score",
                    (F.col("score") >= threshold).cast("int").alias("predicted")))
