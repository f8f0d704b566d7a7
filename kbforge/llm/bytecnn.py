"""Language identification by a convolutional network over bytes (operator 8).

The lower-cased UTF-8 text is cut into windows of ``WINDOW`` bytes, the last one
filled up with zero bytes.  Filters of several widths slide over each window, each
filter's largest answer is kept, and a softmax layer turns those into language
probabilities.  A document's are the mean of its windows', weighted by their
bytes, so the whole text counts.  A filter is a table with one row per byte and
place; for scoring, the tables of two neighbouring places are added up once per
byte pair.

Training is Adam in numpy on windows of about ``max_rows`` documents outside the
held-out fold, the same number of each language as far as there are any and at least
one of each, chosen by a seeded hash of doc_id and text; equal windows are learned from
once.  Every language that occurs is learned; more than ``MAX_LANGUAGES`` different
values of lang are an error, as they cannot be languages.

``und`` with score 0 is returned for null text, text without a letter, and when
there is nothing to learn from.  Rows with a null doc_id are scored but not learned
from.  Of languages with equal probability the first by name is taken.  Repeated rows
are scored separately.  An empty table gives an empty result.
Other columns are not read.
"""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kbforge.llm.common import held_out, map_batches, save

MAX_ROWS = 4_000
MAX_LANGUAGES = 20_000
WINDOW = 128
WIDTHS = (2, 3, 4)
FILTERS = 16
_LETTER = re.compile(r"[^\W\d_]")


def windows(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Windows of a text, shape (n, WINDOW), and the number of text bytes in each."""
    raw = text.lower().encode("utf-8", "surrogatepass")
    n = -(-len(raw) // WINDOW)
    lengths = np.full(n, WINDOW)
    if n:
        lengths[-1] = len(raw) - (n - 1) * WINDOW
    return np.frombuffer(raw.ljust(n * WINDOW, b"\0"), np.uint8).reshape(n, WINDOW), lengths


@dataclass
class Network:
    languages: list[str]
    tables: list[np.ndarray]     # per width: (width, 256, FILTERS)
    offsets: list[np.ndarray]    # per width: (FILTERS,)
    dense: np.ndarray            # (all filters, languages)
    bias: np.ndarray

    def pairs(self) -> list[list[np.ndarray]]:
        """Per width: tables for byte pairs, and for the last byte of an odd width."""
        out = []
        for t in self.tables:
            steps = [(t[j][:, None, :] + t[j + 1][None, :, :]).reshape(65536, -1) for j in range(0, len(t) - 1, 2)]
            out.append(steps + ([t[-1]] if len(t) % 2 else []))
        return out

    def probabilities(self, x: np.ndarray, pairs: list[list[np.ndarray]], rows: int = 1024) -> np.ndarray:
        out = np.empty((len(x), len(self.languages)), np.float32)
        for at in range(0, len(x), rows):
            b = x[at:at + rows].astype(np.int32)
            two = b[:, :-1] * 256 + b[:, 1:]
            pooled = []
            for width, steps, offset in zip(WIDTHS, pairs, self.offsets, strict=True):
                places = WINDOW - width + 1
                total = np.take(steps[0], two[:, :places], axis=0)
                for k, table in enumerate(steps[1:], 1):
                    source = two if table.shape[0] == 65536 else b
                    total += np.take(table, source[:, 2 * k:2 * k + places], axis=0)
                pooled.append(np.maximum(total.max(axis=1) + offset, 0))
            out[at:at + rows] = softmax(np.concatenate(pooled, axis=1) @ self.dense + self.bias)
        return out


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit(x: np.ndarray, y: np.ndarray, languages: list[str], epochs: int = 5, batch: int = 128,
        rate: float = 0.01, seed: int = 5) -> Network:
    """``x``: windows; ``y``: language numbers."""
    rng = np.random.default_rng(seed)
    # only bytes seen in training move; the others stay at zero
    net = Network(languages, [np.zeros((w, 256, FILTERS), np.float32) for w in WIDTHS],
                  [np.zeros(FILTERS, np.float32) for _ in WIDTHS],
                  rng.normal(0, 0.3, (FILTERS * len(WIDTHS), len(languages))).astype(np.float32),
                  np.zeros(len(languages), np.float32))
    used = np.unique(x)
    for t in net.tables:
        t[:, used, :] = rng.normal(0, 0.3, (t.shape[0], len(used), FILTERS))
    params = [*net.tables, *net.offsets, net.dense, net.bias]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for at in range(0, len(order), batch):
            pick = order[at:at + batch]
            b = x[pick].astype(np.int64)
            pooled, best = [], []
            for width, t, offset in zip(WIDTHS, net.tables, net.offsets, strict=True):
                places = WINDOW - width + 1
                total = sum(np.take(t[j], b[:, j:j + places], axis=0) for j in range(width))
                best.append(total.argmax(axis=1))
                pooled.append(np.maximum(total.max(axis=1) + offset, 0))
            h = np.concatenate(pooled, axis=1)
            d = softmax(h @ net.dense + net.bias)
            d[np.arange(len(pick)), y[pick]] -= 1
            d /= len(pick)
            dh = (d @ net.dense.T) * (h > 0)
            grads_t, grads_o = [], []
            rows, cols = np.arange(len(pick))[:, None], np.arange(FILTERS)[None, :]
            for k, width in enumerate(WIDTHS):
                g = dh[:, k * FILTERS:(k + 1) * FILTERS]
                grads_o.append(g.sum(axis=0))
                place = [np.bincount((b[rows, best[k] + j] * FILTERS + cols).ravel(), g.ravel(), 256 * FILTERS)
                         .reshape(256, FILTERS) for j in range(width)]
                grads_t.append(np.stack(place))
            step += 1
            for p, g, m, v in zip(params, [*grads_t, *grads_o, h.T @ d, d.sum(axis=0)], first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-7)
    return net


def train(docs: DataFrame, max_rows: int = MAX_ROWS, per_document: int = 3) -> Network | None:
    """Learn from up to ``per_document`` windows, spread over the text, of the chosen documents."""
    usable = (docs.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull())
              .select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang").where(~held_out(4, 2)))
    counts = usable.groupBy("lang").count().limit(MAX_LANGUAGES + 1).collect()
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not counts:
        return None
    languages = sorted(r["lang"] for r in counts)
    share = max_rows // len(languages) + 1
    spark = docs.sparkSession
    # one row a language
    rates = spark.createDataFrame([(r["lang"], min(1.0, 2 * share / r["count"])) for r in counts], "lang string, rate double")
    draw = F.pmod(F.xxhash64(F.lit("cnn"), "doc_id", "text"), F.lit(1_000_000)) / 1_000_000
    drawn = usable.withColumn("draw", draw).join(F.broadcast(rates), "lang").where("draw < rate")
    # exactly the first ones of each language, at least one; equal texts count once
    first = (drawn.select("lang", "draw", F.xxhash64("text").alias("h")).distinct()
             .withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy("draw", "h")))
             .where(F.col("place") <= share).select("lang", "h").distinct())
    chosen = (drawn.withColumn("h", F.xxhash64("text")).join(F.broadcast(save(first, "chosen")), ["lang", "h"])
              .select("doc_id", "text", "lang"))

    def cut(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {"doc_id": [], "lang": [], "place": [], "bytes": []}
        for doc_id, text, lang in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            x, lengths = windows(text)
            if not _LETTER.search(text):
                continue
            for k in sorted({int(p) for p in np.linspace(0, len(x) - 1, per_document)}):
                for name, v in zip(out, (doc_id, lang, k, x[k].tobytes()), strict=True):
                    out[name].append(v)
        return out

    rows = (map_batches(chosen, cut, "doc_id long, lang string, place int, bytes binary")
            .groupBy("lang", "bytes").agg(F.min("doc_id").alias("doc_id"), F.min("place").alias("place"))
            .orderBy("doc_id", "place", "lang", "bytes").toArrow().to_pydict())
    if not rows["bytes"]:
        return None
    x = np.frombuffer(b"".join(rows["bytes"]), np.uint8).reshape(-1, WINDOW)
    number = {name: k for k, name in enumerate(languages)}
    return fit(x, np.array([number[v] for v in rows["lang"]]), languages)


_PAIRS: dict[str, list] = {}


def _pairs(key: str, net: Network) -> list:
    """The pair tables of a network, kept by the worker for its next tasks (a function of the module, so not shipped)."""
    if key not in _PAIRS:
        _PAIRS.clear()
        _PAIRS[key] = net.pairs()
    return _PAIRS[key]


def predictions(docs: DataFrame, net: Network | None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(net)
    key = uuid.uuid4().hex

    def run(batch: pa.RecordBatch) -> dict:
        net = sent.value
        texts = [t.as_py() for t in batch.column(1)]
        lang, score = ["und"] * len(texts), [0.0] * len(texts)
        known = [k for k, t in enumerate(texts) if t and _LETTER.search(t)] if net else []
        if known:
            pairs, at = _pairs(key, net), 0
            while at < len(known):                   # about 4 MB of windows at a time
                group, size = [], 0
                while at < len(known) and size < 32_768:
                    group.append(windows(texts[known[at]]))
                    size += len(group[-1][0])
                    at += 1
                x = np.concatenate([g[0] for g in group])
                weight = np.concatenate([g[1] for g in group])[:, None]
                p = net.probabilities(x, pairs) * weight
                start = np.concatenate([[0], np.cumsum([len(g[0]) for g in group])[:-1]])
                mean = np.add.reduceat(p, start, axis=0) / np.add.reduceat(weight, start, axis=0)
                for k, row in zip(known[at - len(group):at], mean, strict=True):
                    lang[k] = net.languages[int(row.argmax())]
                    score[k] = float(min(1.0, row.max()))
        return {"doc_id": batch.column(0), "lang_pred": lang, "score": score}

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return (map_batches(rows, run, "doc_id long, lang_pred string, score double")
            .select("doc_id", held_out(4, 2).alias("held_out"), "lang_pred", "score"))
