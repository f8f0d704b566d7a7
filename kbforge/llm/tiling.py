"""Benchmark decontamination by greedy string tiling (operator 7).

Tokens are lower-cased runs of letters, digits and underscores.  Documents and
benchmark items are first joined on seeds, windows of ``min_tile`` tokens; a pair
goes on only if its seeds cover at least ``threshold`` of the item, which bounds
what tiles can cover.  Then the longest common token runs are marked as tiles, the
longest first, no token twice, by running Karp-Rabin: hashes of windows of the
current length, checked token by token, and the length is halved until
``min_tile``.  An item leaks into a document if its tiles cover ``threshold`` of
the item's tokens, in whatever order the document has them.

The benchmark is read in blocks of at most about ``block_tokens`` tokens; each
block is a broadcast of that size, and all documents are scanned once per block.
Nothing of the documents is shuffled.

Null texts are empty texts and match nothing.  Items with fewer than ``min_tile``
tokens are never found.  Repeated items or documents give repeated rows; null ids
stay null.  Empty tables give empty results.  Other columns are not read.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kbforge.llm.common import id_and_text, map_batches

MIN_TILE = 5
THRESHOLD = 0.5
BLOCK_TOKENS = 2_000_000
_TOKEN = re.compile(r"\w+")
_BASE = 0x9E3779B97F4A7C15          # odd, so it has an inverse modulo 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)


def tokens(text: str | None) -> list[str]:
    return _TOKEN.findall(text.lower()) if text else []


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


class Rolling:
    """Karp-Rabin hashes of all windows of any length over an id sequence."""

    def __init__(self, ids: np.ndarray):
        self.n = len(ids)
        sums = np.zeros(self.n + 1, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum((ids + 2).astype(np.uint64) * _powers(_BASE, self.n), out=sums[1:])
        self.sums, self.back = sums, _powers(_INVERSE, self.n)

    def windows(self, length: int) -> np.ndarray:
        if self.n < length:
            return np.zeros(0, np.uint64)
        with np.errstate(over="ignore"):
            return (self.sums[length:] - self.sums[:-length]) * self.back[:self.n - length + 1]


def greedy_tiles(item: np.ndarray, doc: np.ndarray, min_tile: int = MIN_TILE) -> list[tuple[int, int, int]]:
    """Tiles (item start, doc start, length): longest common runs first, none overlapping.

    Negative ids in ``doc`` match nothing.
    """
    item_roll, doc_roll = Rolling(item), Rolling(doc)
    item_free, doc_free = np.ones(len(item), bool), doc >= 0
    tiles: list[tuple[int, int, int]] = []
    length = max(min_tile, min(len(item), len(doc)))
    while True:
        found = True
        while found:                                 # again at this length: leftovers of overlapped runs
            found = False
            runs = _common_runs(item, doc, item_free, doc_free, item_roll, doc_roll, length)
            for size, a, b in sorted(runs, key=lambda r: (-r[0], r[1], r[2])):
                if item_free[a:a + size].all() and doc_free[b:b + size].all():
                    item_free[a:a + size] = doc_free[b:b + size] = False
                    tiles.append((a, b, size))
                    found = True
        if length <= min_tile:
            return tiles
        length = max(min_tile, length // 2)


def _free_windows(free: np.ndarray, length: int) -> np.ndarray:
    """Starts of windows without a marked token."""
    taken = np.concatenate([[0], np.cumsum(~free)])
    return np.flatnonzero(taken[length:] == taken[:-length]) if len(free) >= length else np.zeros(0, np.int64)


def _common_runs(item, doc, item_free, doc_free, item_roll, doc_roll, length) -> list[tuple[int, int, int]]:
    """Maximal common runs of at least ``length`` unmarked tokens, as (length, item start, doc start).

    Only pairs that no longer run reaches from the left are kept and followed, so equal
    tokens in a row do not give all pairs of their places.
    """
    starts, places = _free_windows(item_free, length), _free_windows(doc_free, length)
    if not len(starts) or not len(places):
        return []
    hashes = doc_roll.windows(length)[places]
    order = np.argsort(hashes, kind="stable")
    low, high = (np.searchsorted(hashes[order], item_roll.windows(length)[starts], side=s) for s in ("left", "right"))
    first_a, first_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for a, i, j in zip(starts.tolist(), low.tolist(), high.tolist(), strict=True):
        b = places[order[i:j]]
        if a and item_free[a - 1] and len(b):
            b = b[(b == 0) | ~doc_free[b - 1] | (doc[b - 1] != item[a - 1])]
        first_a.append(np.full(len(b), a))
        first_b.append(b)
    a, b = np.concatenate(first_a), np.concatenate(first_b)
    size, going = np.zeros(len(a), np.int64), np.arange(len(a))
    while len(going):                                # token by token, all runs at once
        x, y = a[going] + size[going], b[going] + size[going]
        inside = (x < len(item)) & (y < len(doc))
        going, x, y = going[inside], x[inside], y[inside]
        going = going[(item[x] == doc[y]) & item_free[x] & doc_free[y]]
        size[going] += 1
    good = size >= length
    return list(zip(size[good].tolist(), a[good].tolist(), b[good].tolist(), strict=True))


class Block:
    """Seed index of some benchmark items, as it is broadcast."""

    def __init__(self, ids: list, texts: list, min_tile: int = MIN_TILE, threshold: float = THRESHOLD):
        self.min_tile, self.threshold = min_tile, threshold
        self.vocabulary: dict[str, int] = {}
        self.item_ids, self.items = [], []
        hashes, item_of, place = [], [], []
        for item_id, text in zip(ids, texts, strict=True):
            words = tokens(text)
            if len(words) < min_tile:
                continue
            seq = np.array([self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words], np.int64)
            h = Rolling(seq).windows(min_tile)
            hashes.append(h)
            item_of.append(np.full(len(h), len(self.items)))
            place.append(np.arange(len(h)))
            self.item_ids.append(item_id)
            self.items.append(seq)
        flat = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        order = np.argsort(flat, kind="stable")
        self.hashes = flat[order]
        self.item_of = np.concatenate(item_of)[order] if hashes else np.zeros(0, np.int64)
        self.place = np.concatenate(place)[order] if hashes else np.zeros(0, np.int64)

    def findings(self, text: str | None) -> list[tuple]:
        """(item_id, coverage, tiles, tokens matched) of every item that leaks into ``text``."""
        get = self.vocabulary.get
        doc = np.array([get(w, -1) for w in tokens(text)], np.int64)
        k = self.min_tile
        if len(doc) < k or not len(self.hashes):
            return []
        places = _free_windows(doc >= 0, k)
        if not len(places):
            return []
        h = Rolling(doc).windows(k)[places]
        low = np.searchsorted(self.hashes, h)
        hit = self.hashes[np.minimum(low, len(self.hashes) - 1)] == h
        if not hit.any():
            return []
        h, places = h[hit], places[hit]
        # every different seed of the document once, with the item places that have it
        seed = np.unique(h)
        low = np.searchsorted(self.hashes, seed)
        count = np.searchsorted(self.hashes, seed, side="right") - low
        entry = np.repeat(low - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
        order = np.argsort(self.item_of[entry], kind="stable")
        cuts = np.flatnonzero(np.diff(self.item_of[entry][order])) + 1
        out = []
        for group in np.split(entry[order], cuts):
            n = int(self.item_of[group[0]])
            item = self.items[n]
            if _covered(self.place[group], k, len(item)).sum() < self.threshold * len(item):
                continue
            # only the seeded stretches of the document can hold tiles of this item
            part = _covered(places[np.isin(h, self.hashes[group])], k, len(doc))
            stretch = np.where(part, doc, -1)[part | np.concatenate([part[1:], [False]])]
            tiles = greedy_tiles(item, stretch, k)
            matched = sum(t[2] for t in tiles)
            if matched >= self.threshold * len(item):
                out.append((self.item_ids[n], matched / len(item), len(tiles), matched))
        return out


def _covered(starts: np.ndarray, length: int, n: int) -> np.ndarray:
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + length, -1)
    return np.cumsum(edge[:-1]) > 0


def blocks(benchmark: DataFrame, min_tile: int = MIN_TILE, threshold: float = THRESHOLD,
           block_tokens: int = BLOCK_TOKENS):
    """Yield a broadcast :class:`Block` for each part of the benchmark of a bounded size."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"),
                             F.coalesce("text", F.lit("")).alias("text"))
    total = items.agg(F.sum(F.regexp_count("text", F.lit(r"(?U)\w+")))).first()[0] or 0
    parts = -(-int(total) // block_tokens)
    spark = benchmark.sparkSession
    for part in range(parts):
        table = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part).toArrow()
        rows = sorted(zip(table["item_id"].to_pylist(), table["text"].to_pylist(), strict=True),
                      key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        yield spark.sparkContext.broadcast(Block([i for i, _ in rows], [t for _, t in rows], min_tile, threshold))


FINDING = "doc_id long, item_id long, coverage double, n_tiles int, n_matched int"


def contamination(docs: DataFrame, benchmark: DataFrame, min_tile: int = MIN_TILE,
                  threshold: float = THRESHOLD, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(doc_id, item_id, coverage, n_tiles, n_matched) for every leak of an item into a document."""
    out = docs.sparkSession.createDataFrame([], FINDING)
    for block in blocks(benchmark, min_tile, threshold, block_tokens):
        def run(batch: pa.RecordBatch, block=block) -> dict:
            cols: dict[str, list] = {"doc_id": [], "item_id": [], "coverage": [], "n_tiles": [], "n_matched": []}
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for item_id, coverage, n_tiles, matched in block.value.findings(text.as_py()):
                    for name, v in zip(cols, (doc_id, item_id, coverage, n_tiles, matched), strict=True):
                        cols[name].append(v)
            return cols

        out = out.unionByName(map_batches(id_and_text(docs), run, FINDING))
    return out


def clean(docs: DataFrame, benchmark: DataFrame, min_tile: int = MIN_TILE, threshold: float = THRESHOLD,
          block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """The rows of ``docs``, all columns, into whose text no item leaks (decided row by row)."""
    for block in blocks(benchmark, min_tile, threshold, block_tokens):
        docs = docs.where(_free_of(block)(F.coalesce("text", F.lit(""))))
    return docs


def _free_of(block):
    @F.pandas_udf("boolean")
    def free(text: pd.Series) -> pd.Series:
        return pd.Series([not block.value.findings(t) for t in text], dtype=bool)

    return free
