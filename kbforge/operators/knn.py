"""Exact k-nearest-neighbour search by cosine distance (VEC-3 / JOIN-4 / TOP-2 / WIN-1).

Plan
----
1. Both sides are counted (ids only) and cut by id hash into blocks of at most
   ``block_bytes`` of vectors.  Neither side passes through the driver.
2. Every query block meets every corpus block in one task (a cogroup on the pair of
   block numbers, as Arrow arrays): the stated query set against all rows, in blocks.
   Inside, matrix products of single precision score a tile at a time, the few rows
   that can be among the ``k`` nearest are scored exactly, and a running top-k per
   query is kept, so a pair of blocks gives at most ``k`` rows per query and no pair
   list exists.
3. Those ``k x corpus blocks`` rows per query are reduced to ``k`` in two levels:
   first per query and group of ``MERGE_FAN_IN`` corpus blocks, then per query, so
   no merge reads more than ``k x MERGE_FAN_IN`` rows of a query at the first level.

Shuffle volume: corpus x query blocks + queries x corpus blocks.  Block sizes come
from the data and the block bound, not from how the inputs happen to be split.

Distances are ``1 - dot / sqrt(|a|^2 |b|^2)`` (1.0 for an all-zero vector); ties
break by ascending corpus id so ranks are deterministic.
"""

from __future__ import annotations

import math
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import block_limit

# Numbers of vectors that are gathered at once inside a task.
CELLS_PER_CHUNK = 2_000_000
# Queries, and corpus rows, of one matrix product.
TILE = 1024
# Every pair of blocks is meant to be a task of its own, up to so many tasks.
MAX_PAIR_TASKS = 4096
NO_ID = -(1 << 63)
# Corpus blocks whose results are merged at the first level.
MERGE_FAN_IN = 64
# A corpus block below this many rows is not cut further only to occupy more tasks.
MIN_BLOCK_ROWS = 256


def topk_columns(d: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per column of ``d`` (rows = candidates, cols = queries) the ``k`` smallest
    distances, ties by smaller id.  Returns flat (col, id, dist) arrays."""
    m, nq = d.shape
    if m == 0 or nq == 0:
        e = np.zeros(0, dtype=np.int64)
        return e, e, np.zeros(0)
    if ids.ndim == 1:
        ids = np.broadcast_to(ids[:, None], d.shape)
    if m > k:
        kth = np.partition(d, k - 1, axis=0)[k - 1]
        mask = d <= kth[None, :]
    else:
        mask = np.ones(d.shape, dtype=bool)
    rows, cols = np.nonzero(mask)
    dsel = d[rows, cols]
    isel = ids[rows, cols]
    order = np.lexsort((isel, dsel, cols))
    cols, isel, dsel = cols[order], isel[order], dsel[order]
    # position of each entry inside its column group
    starts = np.r_[0, np.flatnonzero(np.diff(cols)) + 1]
    counts = np.diff(np.r_[starts, len(cols)])
    pos = np.arange(len(cols)) - np.repeat(starts, counts)
    keep = (pos < k) & np.isfinite(dsel)
    return cols[keep], isel[keep], dsel[keep]


def _vectors_to_matrix(col: pd.Series, dim: int | None = None) -> np.ndarray:
    if len(col) == 0:
        return np.zeros((0, dim or 0))
    return np.stack([np.asarray(v, dtype=np.float64) for v in col.to_numpy()])


def flat(column) -> tuple[np.ndarray, np.ndarray]:
    """(values, lengths) of an Arrow list column without nulls."""
    arr = column.combine_chunks()
    return np.asarray(arr.flatten()), np.asarray(arr.value_lengths())


def matrix(column) -> np.ndarray:
    """Rows of an Arrow list column without nulls; a view of its buffer where that is possible."""
    values, size = flat(column)
    if len(size) and (size != size[0]).any():
        raise ValueError("vectors must all have the same length")
    return values.astype(np.float64, copy=False).reshape(len(size), int(size[0])) if len(size) else np.zeros((0, 0))


def runs(*sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts of the runs of equal keys, place of every row in its run) of columns sorted together."""
    new = np.ones(len(sorted_keys[0]), bool)
    new[1:] = np.any([k[1:] != k[:-1] for k in sorted_keys], axis=0)
    starts = np.flatnonzero(new)
    return starts, np.arange(len(new)) - np.repeat(starts, np.diff(np.append(starts, len(new))))


def rivals(ids: np.ndarray, mat: np.ndarray, k: int, exclude_self: bool) -> np.ndarray:
    """Rows without the copies of a vector that can be in no result: ``k`` copies of smaller ids come before them.

    With ``exclude_self`` one id may be left out, so ``2k`` copies stay, at most ``k`` of them of one id.
    """
    words = np.ascontiguousarray(mat).view(np.uint64)
    odd = np.random.default_rng(5).integers(0, 1 << 63, mat.shape[1], dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    mark = np.empty(len(ids), np.uint64)
    for at in range(0, len(ids), 4096):
        w = words[at:at + 4096]
        mark[at:at + 4096] = ((w ^ (w >> np.uint64(29))) * odd).sum(axis=1)
    order = np.lexsort((ids, mark))
    starts, place = runs(mark[order])
    if len(starts) == len(ids):
        return np.arange(len(ids))
    most, spare = k, np.zeros(len(ids), bool)
    if exclude_self:
        _, of_id = runs(mark[order], ids[order])
        spare = of_id >= k
        kept = np.cumsum(~spare)
        place = kept - np.repeat(kept[starts] - 1, np.diff(np.append(starts, len(ids)))) - 1
        most = 2 * k
    lead = order[np.repeat(starts, np.diff(np.append(starts, len(ids))))]
    for at in range(0, len(ids), 4096):         # equal marks are no proof: the vectors must be equal
        if not np.array_equal(words[order[at:at + 4096]], words[lead[at:at + 4096]]):
            return np.arange(len(ids))
    return np.sort(order[~spare & (place < most)])


def squares(mat: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", mat, mat)


def unit32(mat: np.ndarray, square: np.ndarray) -> np.ndarray | None:
    """Unit rows in single precision (zero rows stay); None if a length is beyond what scaling bears."""
    if not np.all((square == 0) | ((square > 1e-200) & (square < 1e200))):
        return None
    out = np.empty(mat.shape, np.float32)
    for at in range(0, len(mat), 4096):
        norm = np.sqrt(square[at:at + 4096])
        out[at:at + 4096] = mat[at:at + 4096] / np.where(norm > 0, norm, 1)[:, None]
    return out


class TopKAccumulator:
    """Running top-k per query over corpus chunks (numpy, inside one task).

    A product in single precision finds the rows that may be among the ``k`` nearest: those
    whose similarity is not below the ``k``-th best so far by more than its rounding.  Only
    their distances are computed, row by row in double precision, so equal vectors are at
    equal distances and ids break ties.  Memory: ``TILE`` squared similarities, (twice that for large ``k``), distances
    of ``CELLS_PER_CHUNK / dim`` rows at a time, and the ``queries x k`` best so far.
    """

    longest = 1.0       # length that no row of the product exceeds

    def __init__(self, qids: np.ndarray, qmat: np.ndarray, k: int, exclude_self: bool = False):
        self.qids, self.qmat, self.k, self.exclude_self = qids, qmat, k, exclude_self
        self.nq = len(qids)
        self.qn = squares(qmat)
        self.unit = unit32(qmat, self.qn)
        self.best_d = np.full((self.nq, k), np.inf)
        self.best_i = np.zeros((self.nq, k), dtype=np.int64)

    def add(self, ids_all: np.ndarray, mat_all: np.ndarray, who: np.ndarray | None = None) -> None:
        """Score rows for all queries, or for those at the places ``who``."""
        who = np.arange(self.nq) if who is None else who
        if len(who) == 0 or len(ids_all) == 0:
            return
        if len(ids_all) > TILE:
            stay = rivals(ids_all, mat_all, self.k, self.exclude_self)
            if len(stay) < len(ids_all):
                ids_all, mat_all = ids_all[stay], mat_all[stay]
        square, unit = self._rows(mat_all)
        # long results are merged less often, so that the products stay the larger part
        rows = min(16 * TILE, max(TILE, 64 * self.k))
        step = max(TILE // 16, min(TILE, 2 * TILE * TILE // rows))
        for at in range(0, len(who), step):
            some = who[at:at + step]
            for s in range(0, len(ids_all), rows):
                part = slice(s, s + rows)
                self._tile(some, ids_all[part], mat_all[part], square[part], None if unit is None else unit[part])

    def _rows(self, mat: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
        """(squared lengths, rows of the product in single precision) of corpus rows."""
        square = squares(mat)
        return square, unit32(mat, square)

    def _tile(self, who: np.ndarray, ids: np.ndarray, mat: np.ndarray, square: np.ndarray, unit: np.ndarray | None) -> None:
        if unit is None or self.unit is None:
            sim = np.nan_to_num(1.0 - self._distances(self.qmat[who] @ mat.T, self.qn[who][:, None], square[None, :]),
                                nan=-3.0, posinf=-3.0, neginf=-3.0)
        else:
            sim = self.unit[who] @ unit.T
        kth = self.best_d[who, -1]
        limit = 1.0 - kth
        first = np.flatnonzero(np.isinf(kth))
        if len(first) and len(ids) > self.k:
            seen = sim[first]
            if self.exclude_self:
                seen[self.qids[who[first]][:, None] == ids[None, :]] = -2.0
            limit[first] = np.partition(seen, len(ids) - self.k, axis=1)[:, len(ids) - self.k]
        # twice the bound on the rounding of a product of two unit vectors in single precision
        limit -= 2 * self.longest * (mat.shape[1] + 8) * 2.0 ** -23
        cell = np.flatnonzero(sim >= limit.astype(sim.dtype)[:, None])
        step = max(1, CELLS_PER_CHUNK // max(1, mat.shape[1]))
        for at in range(0, len(cell), step):
            q, c = np.divmod(cell[at:at + step], len(ids))
            q = who[q]
            if self.exclude_self:
                other = self.qids[q] != ids[c]
                q, c = q[other], c[other]
            d = self._distances(np.einsum("ij,ij->i", self.qmat[q], mat[c]), self.qn[q], square[c])
            self._merge(q, ids[c], d)

    @staticmethod
    def _distances(dots, qn, square):
        with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
            den = np.sqrt(qn * square)
            return np.where(den == 0, 1.0, 1.0 - dots / den)

    def _merge(self, q: np.ndarray, ids: np.ndarray, d: np.ndarray) -> None:
        keep = np.isfinite(d) & (d <= self.best_d[q, -1])
        q, ids, d = q[keep], ids[keep], d[keep]
        if not len(q):
            return
        met = np.unique(q)
        q = np.concatenate([np.repeat(met, self.k), q])
        ids = np.concatenate([self.best_i[met].ravel(), ids])
        d = np.concatenate([self.best_d[met].ravel(), d])
        order = np.lexsort((ids, d, q))
        _, place = runs(q[order])
        order, place = order[place < self.k], place[place < self.k]
        self.best_d[q[order], place], self.best_i[q[order], place] = d[order], ids[order]

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query id, id, distance) of the best rows, by query and rank."""
        r, c = np.nonzero(np.isfinite(self.best_d))
        return self.qids[r].astype(np.int64), self.best_i[r, c], self.best_d[r, c]

    def result(self) -> pd.DataFrame:
        return pd.DataFrame(dict(zip(("query_id", "id", "distance"), self.found(), strict=True)))


def _score_blocks(k: int, exclude_self: bool):
    import pyarrow as pa

    target = pa.schema([("query_id", pa.int64()), ("id", pa.int64()), ("distance", pa.float64()), ("part", pa.int64())])

    def score(corpus, queries):
        corpus, queries = with_vector(corpus, "_cv"), with_vector(queries, "_qv")
        if not corpus.num_rows or not queries.num_rows:
            return target.empty_table()
        part = corpus["_cb"][0].as_py() // MERGE_FAN_IN
        acc = TopKAccumulator(id_array(queries["_qid"]), matrix(queries["_qv"]), k, exclude_self)
        acc.add(id_array(corpus["_cid"]), matrix(corpus["_cv"]))
        qid, cid, d = acc.found()
        return pa.Table.from_arrays([pa.array(x) for x in (qid, cid, d, np.full(len(qid), part, np.int64))], schema=target)
    return score


def with_vector(rows, column: str):
    return rows.filter(rows[column].is_valid()) if rows[column].null_count else rows


def id_array(column) -> np.ndarray:
    """Ids of an Arrow column; a null id counts as the smallest number."""
    return np.asarray(column.combine_chunks().fill_null(NO_ID))


def _blocks(rows: int, row_bytes: int, block_bytes: int, at_least: int = 1) -> int:
    return max(1, at_least, math.ceil(rows * row_bytes / block_bytes))


def knn_candidates(spark: SparkSession, corpus: DataFrame, queries: DataFrame, k: int = 5,
                   corpus_id: str = "id", corpus_vec: str = "embedding",
                   query_id: str = "query_id", query_vec: str = "embedding",
                   exclude_self: bool = False, dim: int | None = None,
                   block_bytes: int | None = None) -> DataFrame:
    """Top-k candidates (query_id, id, distance) of every pair of blocks; see module doc.

    ``dim`` (vector length) sizes the blocks; when not given it is read from the
    data.  ``block_bytes`` defaults to ``spark.kbforge.block.maxBytes``.
    """
    # rows without a vector are skipped inside the numpy code, not by a filter: a
    # filter would be pushed below the embedding projection and run the embedder twice
    q = queries.select(F.col(query_id).cast("long").alias("_qid"), F.col(query_vec).alias("_qv"))
    c = corpus.select(F.col(corpus_id).cast("long").alias("_cid"), F.col(corpus_vec).alias("_cv"))
    if dim is None:
        dim = q.agg(F.max(F.size("_qv"))).first()[0] or 1
    bound, row = block_bytes or block_limit(spark), 8 * max(dim, 1) + 16
    n_q, n_c = q.select("_qid").count(), c.select("_cid").count()
    q_blocks = _blocks(n_q, row, bound)
    # enough pairs to occupy the cluster, as long as a block has a matrix worth multiplying
    spread = min(math.ceil(spark.sparkContext.defaultParallelism / q_blocks), math.ceil(n_c / MIN_BLOCK_ROWS))
    c_blocks = _blocks(n_c, row, bound, spread)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = (c.withColumn("_cb", F.pmod(F.xxhash64("_cid"), F.lit(c_blocks)).cast("int"))
            .withColumn("_qb", every(q_blocks)))
    right = (q.withColumn("_qb", F.pmod(F.xxhash64("_qid"), F.lit(q_blocks)).cast("int"))
             .withColumn("_cb", every(c_blocks)))
    # a stated number of partitions: small ones would be put together, and their pairs wait for each other
    tasks = min(q_blocks * c_blocks, MAX_PAIR_TASKS)
    left, right = (side.repartition(tasks, "_qb", "_cb").groupBy("_qb", "_cb") for side in (left, right))
    pairs = left.cogroup(right).applyInArrow(_score_blocks(k, exclude_self), "query_id long, id long, distance double, part long")
    if c_blocks > MERGE_FAN_IN:
        w = Window.partitionBy("query_id", "part").orderBy("distance", "id")
        pairs = pairs.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r")
    return pairs.drop("part")


def rank_topk(cands: DataFrame, k: int, group: str = "query_id",
              order: tuple[str, ...] = ("distance", "id")) -> DataFrame:
    """WIN-1 / TOP-2: ``rank`` 1..k per group by ascending (distance, id)."""
    w = Window.partitionBy(group).orderBy(*[F.col(c).asc() for c in order])
    return cands.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def knn_search(spark: SparkSession, corpus: DataFrame, queries: DataFrame, k: int = 5,
               corpus_id: str = "id", corpus_vec: str = "embedding",
               query_id: str = "query_id", query_vec: str = "embedding",
               exclude_self: bool = False, dim: int | None = None,
               block_bytes: int | None = None) -> DataFrame:
    """VEC-3: long result (query_id, rank, id, distance), ``rank`` 1..k ascending
    distance.  Fewer than ``k`` rows when the corpus is smaller."""
    cands = knn_candidates(spark, corpus, queries, k, corpus_id, corpus_vec,
                           query_id, query_vec, exclude_self, dim, block_bytes)
    return rank_topk(cands, k).select("query_id", "rank", "id", "distance")


def zip_results(hits: DataFrame) -> DataFrame:
    """JOIN-5: list-shaped result per query (ids, distances in rank order), the
    shape a vector-store client returns; long form stays the default elsewhere."""
    g = hits.groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", "id", "distance"))).alias("_r"))
    return g.select("query_id",
                    F.transform("_r", lambda x: x["id"]).alias("ids"),
                    F.transform("_r", lambda x: x["distance"]).alias("distances"))


def unzip_results(lists: DataFrame) -> DataFrame:
    """JOIN-5 inverse: parallel lists back to one row per (query, rank)."""
    z = lists.select("query_id", F.posexplode(F.arrays_zip("ids", "distances")).alias("p", "z"))
    return z.select("query_id", (F.col("p") + 1).alias("rank"),
                    F.col("z.ids").alias("id"), F.col("z.distances").alias("distance"))
