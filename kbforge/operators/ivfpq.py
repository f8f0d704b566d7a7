"""VEC-4, compressed: an inverted file of product-quantised residuals with exact re-ranking.

Build: every vector is scaled to unit length and given to its nearest centroid, as in
:mod:`.ivf`; what the centroid leaves over (the residual) is cut into ``parts`` pieces,
and each piece is replaced by the number of its nearest codeword, one byte.  The codes
(id, cluster, code) are one table and the vectors (id, embedding) another, so a
search reads ``parts`` bytes a row instead of a vector.

Search: the inner product of a query with a coded row is its product with the centroid
plus its pieces' products with the codewords.  Codes are scanned in blocks that meet the
queries routed to them (:class:`.ivf.Blocks`); a task makes vectors of some codes at a
time, scores them against all its queries in one matrix product, and keeps a short list
per query.  Only the vectors of the ``shortlist`` best rows per query over all
blocks are read, and those are ranked exactly.

The codebooks are trained on at most ``train_rows`` rows, those of the smallest seeded
hash of id; every row is coded.  Centroids and codebooks are all that is broadcast and
are checked against the bound.  Rows and queries without a vector are left out; a
zero vector has distance 1 to all, as in the exact search.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import paired_distances
from ..session import block_limit, broadcast_limit, run_folder
from .ivf import Blocks, IvfIndex, _routed, _scan_plan
from .knn import (TopKAccumulator, _vectors_to_matrix, flat, id_array, knn_search, matrix, rank_topk, squares,
                  topk_columns)

PARTS = 16
CODEWORDS = 256
TRAIN_ROWS = 20_000
MAX_GROUP_CODES = 500_000
MIN_GROUP_QUERIES = 2_000
DECODED = 16_384            # rows held as vectors at once in a task


@dataclass
class PqIndex:
    codes: DataFrame             # (id long, cluster int, code binary)
    vectors: DataFrame           # (id long, embedding)
    centroids: np.ndarray        # (n_clusters, dim), unit rows
    codebooks: np.ndarray        # (parts, codewords, dim / parts)
    cluster_sizes: dict


def pieces(x: np.ndarray, parts: int) -> np.ndarray:
    """(parts, rows, dim / parts); the last piece is filled up with zeros."""
    rows, dim = x.shape
    width = -(-dim // parts)
    return np.pad(x, ((0, 0), (0, parts * width - dim))).reshape(rows, parts, width).transpose(1, 0, 2)


def train_codebooks(residuals: np.ndarray, parts: int, codewords: int = CODEWORDS, rounds: int = 12,
                    seed: int = 3) -> np.ndarray:
    """Lloyd's algorithm for each piece."""
    rng = np.random.default_rng(seed)
    out = []
    for x in pieces(residuals, parts):
        words = x[rng.permutation(len(x))[:codewords]]
        words = np.concatenate([words, np.zeros((codewords - len(words), x.shape[1]))])
        for _ in range(rounds):
            own = nearest_words(x, words)
            count = np.bincount(own, minlength=codewords)
            sums = np.stack([np.bincount(own, x[:, d], codewords) for d in range(x.shape[1])], axis=1)
            words = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], words)
            idle = np.flatnonzero(count == 0)               # unused words start again at the worst coded rows
            far = np.argsort(-((x - words[own]) ** 2).sum(axis=1), kind="stable")[:len(idle)]
            words[idle[:len(far)]] = x[far]
        out.append(words)
    return np.array(out)


def nearest_words(x: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Number of the nearest codeword of each row (ties: the first)."""
    out = np.empty(len(x), np.int64)
    norm = (words ** 2).sum(axis=1)
    for at in range(0, len(x), 8192):
        out[at:at + 8192] = (norm - 2 * (x[at:at + 8192] @ words.T)).argmin(axis=1)
    return out


def encode(x: np.ndarray, codebooks: np.ndarray) -> np.ndarray:
    """(rows, parts) bytes."""
    return np.stack([nearest_words(p, w) for p, w in zip(pieces(x, len(codebooks)), codebooks, strict=True)],
                    axis=1).astype(np.uint8)


def unit_rows(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(norm > 0, norm, 1)


def build_ivfpq(index: IvfIndex, path: str, parts: int = PARTS, train_rows: int = TRAIN_ROWS) -> PqIndex:
    """Code every row of a clustered index and write ``<path>/codes`` (by cluster) and ``<path>/vectors``."""
    spark = index.assigned.sparkSession
    rows = index.assigned.select(F.col(index.id_col).cast("long").alias("id"), F.col(index.vec_col).alias("embedding"),
                                 "cluster").where(F.col("embedding").isNotNull())
    sample = rows.orderBy(F.xxhash64(F.lit("pq"), "id"), "id").limit(train_rows).toPandas()
    width = index.centroids.shape[1]
    residual = (unit_rows(_vectors_to_matrix(sample["embedding"], width)) - index.centroids[sample["cluster"].to_numpy(int)]
                if len(sample) else np.zeros((1, width)))
    codebooks = train_codebooks(residual, parts)
    return write_codes(spark, rows, index.centroids, codebooks, path)


def write_codes(spark: SparkSession, rows: DataFrame, centroids: np.ndarray, codebooks: np.ndarray, path: str) -> PqIndex:
    """Code ``rows`` (id, embedding, cluster) for given centroids and codebooks."""
    if centroids.nbytes + codebooks.nbytes > broadcast_limit(spark):
        raise ValueError("centroids and codebooks exceed the broadcast bound spark.kbforge.broadcast.maxBytes")
    sent = spark.sparkContext.broadcast((centroids, codebooks))

    def code(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        centers, books = sent.value
        for pdf in batches:
            if len(pdf):
                own = pdf["cluster"].to_numpy(int)
                codes = encode(unit_rows(_vectors_to_matrix(pdf["embedding"])) - centers[own], books)
                yield pd.DataFrame({"id": pdf["id"], "cluster": pdf["cluster"], "code": [c.tobytes() for c in codes]})

    rows.select("id", "embedding").write.mode("overwrite").parquet(f"{path}/vectors")
    coded = rows.mapInPandas(code, "id long, cluster int, code binary")
    coded.repartition("cluster").write.mode("overwrite").partitionBy("cluster").parquet(f"{path}/codes")
    (spark.createDataFrame([(i, [float(v) for v in c]) for i, c in enumerate(centroids)], "cluster int, centroid array<double>")
     .coalesce(1).write.mode("overwrite").parquet(f"{path}/centroids"))
    flat = [(p, w, [float(v) for v in word]) for p, book in enumerate(codebooks) for w, word in enumerate(book)]
    (spark.createDataFrame(flat, "part int, word int, value array<double>")
     .coalesce(1).write.mode("overwrite").parquet(f"{path}/codebooks"))
    return open_ivfpq(spark, path)


def open_ivfpq(spark: SparkSession, path: str) -> PqIndex:
    centers = sorted(spark.read.parquet(f"{path}/centroids").collect(), key=lambda r: r["cluster"])
    words = sorted(spark.read.parquet(f"{path}/codebooks").collect(), key=lambda r: (r["part"], r["word"]))
    parts = words[-1]["part"] + 1
    books = np.array([r["value"] for r in words]).reshape(parts, len(words) // parts, -1)
    codes = spark.read.schema("id long, code binary, cluster int").parquet(f"{path}/codes")
    sizes = {r["cluster"]: r["n"] for r in codes.groupBy("cluster").agg(F.count(F.lit(1)).alias("n")).collect()}
    return PqIndex(codes, spark.read.parquet(f"{path}/vectors"), np.array([r["centroid"] for r in centers]), books, sizes)


class _Coded(TopKAccumulator):
    """Running short lists of unit queries over decoded rows, which are not scaled."""

    def _rows(self, mat):
        self.longest = max(1.0, float(np.sqrt(squares(mat).max(initial=0.0))))
        return np.ones(len(mat)), mat.astype(np.float32)

    @staticmethod
    def _distances(dots, qn, square):
        return 1.0 - dots


def decode(code: np.ndarray, cluster: np.ndarray, centers: np.ndarray, books: np.ndarray) -> np.ndarray:
    """The vectors that codes stand for: centroid plus the codeword of every piece."""
    width = centers.shape[1]
    return centers[cluster] + np.concatenate([b[code[:, p]] for p, b in enumerate(books)], axis=1)[:, :width]


def _asked(cluster: np.ndarray, probed: np.ndarray, who: np.ndarray, n_queries: int) -> Iterator[tuple]:
    """(places of rows, places of the queries that ask for them); one pair if all queries ask for all rows.

    No cluster at all is what queries have that ask for every one.
    """
    named = np.unique(cluster)
    if not len(probed) or np.isin(probed, named).sum() == len(named) * n_queries:
        yield np.arange(len(cluster)), None
        return
    for c in named.tolist():
        asking = who[probed == c]
        if len(asking):
            yield np.flatnonzero(cluster == c), asking


def _short_lists(sent, keep: int, exclude_self: bool):
    """Cogrouped codes and queries -> at most ``keep`` (query_id, id, approximate distance) a query."""
    import pyarrow as pa

    target = pa.schema([("query_id", pa.int64()), ("id", pa.int64()), ("near", pa.float64())])

    def score(codes, queries):
        centers, books = sent.value
        if not codes.num_rows or not queries.num_rows:
            return target.empty_table()
        code = np.frombuffer(b"".join(codes["code"].to_pylist()), np.uint8).reshape(codes.num_rows, -1)
        ids, cluster = id_array(codes["id"]), np.asarray(codes["cluster"])
        q, qids = unit_rows(matrix(queries["_qv"])), id_array(queries["_qid"])
        probed, count = flat(queries["clusters"])
        acc = _Coded(qids, q, keep, exclude_self)
        for own, asking in _asked(cluster, probed, np.repeat(np.arange(len(count)), count), len(qids)):
            for at in range(0, len(own), DECODED):       # some rows at a time are made vectors again
                some = own[at:at + DECODED]
                acc.add(ids[some], decode(code[some], cluster[some], centers, books), asking)
        return pa.Table.from_arrays([pa.array(x) for x in acc.found()], schema=target)

    return score


def _exact_distances(batches: Iterator) -> Iterator:
    """(query_id, id, distance) of pairs of vectors."""
    import pyarrow as pa

    for batch in batches:
        if batch.num_rows:
            pairs = pa.Table.from_batches([batch])
            distance = paired_distances(matrix(pairs["_qv"]), matrix(pairs["embedding"]))
            yield pa.RecordBatch.from_arrays([batch.column("query_id"), batch.column("id"), pa.array(distance)],
                                             names=["query_id", "id", "distance"])


def group_queries(spark: SparkSession, dim: int, shortlist: int, asked: int) -> int:
    """Queries of a task, of ``asked`` over all blocks: as many vectors and short lists as a block's bytes
    hold, since codes are sent and made vectors for every group of queries; fewer if cores were idle."""
    held = block_limit(spark) // (12 * dim + 16 * shortlist)
    return max(MIN_GROUP_QUERIES, min(held, -(-asked // (4 * spark.sparkContext.defaultParallelism))))


def ivfpq_search(spark: SparkSession, index: PqIndex, queries: DataFrame, k: int = 5, nprobe: int | None = None,
                 shortlist: int = 50, query_id: str = "query_id", query_vec: str = "embedding", exclude_self: bool = False,
                 max_group_codes: int = MAX_GROUP_CODES, max_group_queries: int | None = None) -> DataFrame:
    """Long result (query_id, rank, id, distance); ``nprobe`` None scans the codes of all clusters.

    Distances are exact; only the vectors of ``shortlist`` rows a query are read for them.
    ``max_group_queries`` is by default what :func:`group_queries` says.
    """
    n_clusters = len(index.centroids)
    probes = n_clusters if nprobe is None else max(1, min(nprobe, n_clusters))
    centers = spark.sparkContext.broadcast(index.centroids)
    sent = spark.sparkContext.broadcast((index.centroids, index.codebooks))
    q = queries.select(F.col(query_id).cast("long").alias("_qid"), F.col(query_vec).alias("_qv"))
    blocks = Blocks(index.cluster_sizes, n_clusters, max_group_codes)
    every = probes == n_clusters

    def nearest(distance, angle, part):
        cols, sel, _ = topk_columns(distance, np.arange(n_clusters), probes)
        return np.split(sel, np.searchsorted(cols, np.arange(1, len(part))))

    routed = _routed(q, centers, blocks, None if every else nearest)
    n_asked = routed.count()
    if not n_asked:
        return spark.createDataFrame([], "query_id long, rank int, id long, distance double")
    most = max_group_queries or group_queries(spark, index.centroids.shape[1], shortlist, n_asked)
    codes, asked = _scan_plan(spark, index.codes, "id", routed, blocks, most, every)
    near = (codes.groupBy("block", "qsub").cogroup(asked.groupBy("block", "qsub"))
            .applyInArrow(_short_lists(sent, shortlist, exclude_self), "query_id long, id long, near double"))
    path = run_folder(spark, "short-lists")
    rank_topk(near, shortlist, order=("near", "id")).select("query_id", "id").write.parquet(path)
    listed = spark.read.parquet(path)
    pairs = (listed.join(index.vectors, "id")
             .join(q.where(F.col("_qv").isNotNull()), F.col("query_id") == F.col("_qid"))
             .select("query_id", "id", "_qv", "embedding"))
    exact = pairs.mapInArrow(_exact_distances, "query_id long, id long, distance double")
    return rank_topk(exact, k).select("query_id", "rank", "id", "distance")


def choose_shortlist(spark: SparkSession, index: PqIndex, queries: DataFrame, k: int = 5, recall: float = 0.95,
                     query_id: str = "query_id", query_vec: str = "embedding", exclude_self: bool = False,
                     nprobe: int | None = None, sample_rows: int = 300, most: int = 400) -> int:
    """The shortest list, doubled from ``2k``, with which a sample of the queries finds ``recall`` of its exact neighbours."""
    sample = (queries.where(F.col(query_vec).isNotNull()).orderBy(F.xxhash64(F.lit("pq"), query_id), query_id).limit(sample_rows))
    path = run_folder(spark, "pq-sample")
    sample.select(F.col(query_id).alias("query_id"), F.col(query_vec).alias("_v")).write.parquet(path)
    sample = spark.read.parquet(path)
    truth = run_folder(spark, "pq-truth")
    knn_search(spark, index.vectors, sample, k, query_vec="_v", exclude_self=exclude_self).write.parquet(truth)
    true = spark.read.parquet(truth).select("query_id", "id")
    wanted, size = true.count(), 2 * k
    while size < most:
        got = ivfpq_search(spark, index, sample, k, nprobe, size, query_vec="_v", exclude_self=exclude_self)
        if got.select("query_id", "id").join(true, ["query_id", "id"]).count() >= recall * wanted:
            return size
        size *= 2
    return most


__all__ = ["PqIndex", "build_ivfpq", "choose_shortlist", "encode", "ivfpq_search", "open_ivfpq", "train_codebooks", "write_codes"]
