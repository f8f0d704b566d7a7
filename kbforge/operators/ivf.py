"""VEC-4: inverted-file (clustered) approximate cosine search.

Build: unit-normalise vectors, train ``pyspark.ml`` KMeans (cosine), store each
record with its ``cluster`` (``write.partitionBy('cluster')`` when persisted, so
a probe reads only the chosen cluster folders).

Search:
1. Each query is scored against the centroids (``n_clusters x dim`` values,
   a bounded broadcast) and keeps its ``nprobe`` nearest clusters.
2. Clusters are packed into *blocks* of at most ``max_group_rows`` corpus rows, by default
   what ``spark.kbforge.block.maxBytes`` holds of their length (:func:`block_rows`); a larger cluster is split over several blocks, so one holding a third of the corpus is
   scored by many tasks.  A query is sent once to each block that has one of its
   clusters, with the list of them; blocks that many queries probe are split by query
   (``max_group_queries``).
3. Corpus rows and queries meet in ``cogroup(block, qsub)``, as Arrow arrays; each task
   multiplies cluster by cluster and emits at most ``k`` rows per query.
4. ``row_number() <= k`` per query merges the blocks.

The routed queries are written once, so the query embedding behind them is never
computed twice.

With ``nprobe = n_clusters`` every corpus row is scored and the result equals
the exact search (:mod:`kbforge.operators.knn`).  :func:`pruned_search` is exact as well
but leaves out what cannot hold a result: no row of a cluster is nearer to a query
than the angle to its centroid less the cluster's radius (the triangle inequality of
angles), so after a first look at the nearest clusters only those within the k-th
distance found are visited.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from typing import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import block_limit, broadcast_limit, checkpoint_dir, run_folder
from .knn import (TopKAccumulator, _vectors_to_matrix, flat, id_array, knn_search, matrix, rank_topk, runs,
                  topk_columns)

DEFAULT_MAX_GROUP_ROWS = 50_000
DEFAULT_MAX_GROUP_QUERIES = 5_000
TARGET_RECALL = 0.92      # of the sample, so that all queries reach 0.9
SAMPLE_QUERIES = 500
PROBE_ROWS = 20_000
PROBE_CELLS = 1_000_000   # (centroids x rows) angles held at once in a task


@dataclass
class IvfIndex:
    assigned: DataFrame          # (id long, embedding, cluster int)
    centroids: np.ndarray        # (n_clusters, dim), unit rows
    id_col: str
    vec_col: str
    # rows per cluster; only sizes the blocks
    cluster_sizes: dict | None = None
    # largest angle between a row and its centroid, by cluster
    radii: np.ndarray | None = None


def _unit(vec):
    norm = F.sqrt(F.aggregate(vec, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    # the outer function has one row of (vector, length): inside the inner one the length would be computed per number
    once = F.array(F.struct(vec.alias("v"), norm.alias("n")))
    return F.transform(once, lambda s: F.transform(
        s["v"], lambda x: F.when(s["n"] > 0, x.cast("double") / s["n"]).otherwise(F.lit(0.0))))[0]


def cluster_count(n_rows: int, dim: int, bound_bytes: int) -> int:
    """About the square root of the rows, and never more centroids than the broadcast bound holds."""
    return max(1, min(round(math.sqrt(n_rows)), bound_bytes // (8 * max(1, dim))))


def build_ivf(corpus: DataFrame, n_clusters: int | None = None, id_col: str = "id", vec_col: str = "embedding",
              seed: int = 7, max_iter: int = 10) -> IvfIndex:
    """Train centroids on all rows and assign every row to its nearest one.

    Without ``n_clusters`` their number follows the corpus (:func:`cluster_count`).
    """
    feats = corpus.select(F.col(id_col).cast("long").alias(id_col), F.col(vec_col),
                          array_to_vector(_unit(F.col(vec_col))).alias("_features"))
    if n_clusters is None:
        dim = corpus.agg(F.max(F.size(vec_col))).first()[0] or 1
        n_clusters = cluster_count(corpus.select(id_col).count(), dim, broadcast_limit(corpus.sparkSession))
    train = feats.select("_features").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        model = KMeans(k=n_clusters, seed=seed, maxIter=max_iter, distanceMeasure="cosine",
                       featuresCol="_features", predictionCol="cluster").fit(train)
        sizes = {c: int(s) for c, s in enumerate(model.summary.clusterSizes)}
    finally:
        train.unpersist()
    centers = np.array([np.asarray(c, dtype=np.float64) for c in model.clusterCenters()])
    norms = np.linalg.norm(centers, axis=1, keepdims=True)
    centers = np.where(norms > 0, centers / np.where(norms > 0, norms, 1), 0.0)
    assigned = model.transform(feats).select(id_col, vec_col, F.col("cluster").cast("int"))
    return IvfIndex(assigned, centers, id_col, vec_col, sizes)


def assign_ivf(corpus: DataFrame, centroids: np.ndarray, id_col: str = "id", vec_col: str = "embedding") -> IvfIndex:
    """An index over given centroids: every row goes to the one with the largest cosine (ties: the first).

    Rows without a vector have no cluster and are left out.
    """
    norms = np.linalg.norm(centroids, axis=1, keepdims=True)
    unit = np.where(norms > 0, centroids / np.where(norms > 0, norms, 1), 0.0)
    bc = corpus.sparkSession.sparkContext.broadcast(unit)
    rows = corpus.select(F.col(id_col).cast("long").alias("_qid"), F.col(vec_col).alias("_qv"))
    vec_type = rows.schema["_qv"].dataType.simpleString()
    nearest = rows.mapInPandas(_probe_fn(bc, 1), f"_qid long, cluster int, _qv {vec_type}")
    return IvfIndex(nearest.select(F.col("_qid").alias(id_col), F.col("_qv").alias(vec_col), "cluster"), unit,
                    id_col, vec_col)


def persist_ivf(spark: SparkSession, index: IvfIndex, path: str) -> IvfIndex:
    """Cluster-partitioned layout: a probe of cluster c reads only ``cluster=c``.
    Centroids are stored next to it (``_centroids``, one row per cluster)."""
    # a cluster's rows meet in a few tasks (more for large clusters), so it has a few files
    sizes = index.cluster_sizes or {}
    split = math.ceil(max(sizes.values(), default=1) / DEFAULT_MAX_GROUP_ROWS)
    salted = index.assigned.repartition("cluster", F.pmod(F.xxhash64(index.id_col), F.lit(split)))
    salted.write.mode("overwrite").partitionBy("cluster").parquet(path)
    rows = [(i, [float(x) for x in c]) for i, c in enumerate(index.centroids)]
    (spark.createDataFrame(rows, "cluster int, centroid array<double>")
     .coalesce(1).write.mode("overwrite").parquet(f"{path}/_centroids"))
    return open_ivf(spark, path, index.id_col, index.vec_col)


def open_ivf(spark: SparkSession, path: str, id_col: str = "id", vec_col: str = "embedding") -> IvfIndex:
    cents = sorted(spark.read.parquet(f"{path}/_centroids").collect(), key=lambda r: r["cluster"])
    centroids = np.array([r["centroid"] for r in cents], dtype=np.float64)
    return IvfIndex(spark.read.parquet(path), centroids, id_col, vec_col)


def probe_step(n_clusters: int, most: int) -> int:
    """Rows that are compared with all centroids at once."""
    return max(1, min(most, PROBE_CELLS // max(1, n_clusters)))


def _probe_fn(bc, nprobe: int):
    """(_qid, cluster, _qv) of the ``nprobe`` nearest centroids of every row that has a vector."""
    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        centers = bc.value
        cids = np.arange(centers.shape[0], dtype=np.int64)
        for pdf in batches:
            pdf = pdf[pdf["_qv"].notna()]
            # parts of a batch, so that the rows made of it stay few at a time
            step = probe_step(len(centers), PROBE_ROWS // nprobe)
            for at in range(0, len(pdf), step):
                part = pdf.iloc[at:at + step]
                cols, sel, _ = topk_columns(_angles(centers, _vectors_to_matrix(part["_qv"]))[0], cids, nprobe)
                yield pd.DataFrame({"_qid": part["_qid"].to_numpy(dtype=np.int64)[cols],
                                    "cluster": sel.astype(np.int32),
                                    "_qv": part["_qv"].to_numpy()[cols]})
    return probe


def _angles(centers: np.ndarray, qm: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cosine distances (clusters, queries) and their angles; a zero vector is at distance 1 of all."""
    qn = np.linalg.norm(qm, axis=1)
    sim = (centers @ qm.T) / np.where(qn > 0, qn, 1)[None, :]
    return 1.0 - sim, np.arccos(np.clip(sim, -1, 1))


class Blocks:
    """Clusters packed into blocks of at most ``max_rows`` rows; a larger cluster has blocks of its own."""

    def __init__(self, sizes: dict[int, int], n_clusters: int, max_rows: int):
        self.first, self.splits = np.zeros(n_clusters, np.int64), np.ones(n_clusters, np.int64)
        block, held = 0, 0
        for c in range(n_clusters):
            n = max(1, int(sizes.get(c, 1)))
            if held and held + n > max_rows:
                block, held = block + 1, 0
            self.first[c] = block
            self.splits[c] = -(-n // max_rows)
            if self.splits[c] > 1:
                block, held = block + int(self.splits[c]), 0
            else:
                held += n
        self.count = block + 1

    def route(self, clusters: np.ndarray) -> dict[int, list[int]]:
        """Blocks that hold some of ``clusters``, with those."""
        out: dict[int, list[int]] = {}
        for c in clusters.tolist():
            for b in range(int(self.first[c]), int(self.first[c] + self.splits[c])):
                out.setdefault(b, []).append(c)
        return out


def block_rows(spark: SparkSession, dim: int) -> int:
    """Rows of a block: a task holds all of one, so long vectors make it shorter."""
    return max(1, min(DEFAULT_MAX_GROUP_ROWS, block_limit(spark) // (8 * max(1, dim) + 16)))


ROUTED = "_qid long, block int, clusters array<int>, _qv array<double>"


def _routed(q: DataFrame, bc, blocks: Blocks, choose: Callable | None) -> DataFrame:
    """Each query once per block that has a cluster ``choose(distances, angles, batch)`` names for it.

    ``q`` is (_qid, _qv, further columns that ``choose`` reads); written once.  Without ``choose``
    a query goes to every block, and its list of clusters is empty and means all of them.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        centers = bc.value
        for pdf in batches:
            pdf = pdf[pdf["_qv"].notna()]
            step = probe_step(len(centers), 512)
            for at in range(0, len(pdf), step):
                part = pdf.iloc[at:at + step]
                out: dict[str, list] = {"_qid": [], "block": [], "clusters": [], "_qv": []}
                distance, angle = _angles(centers, _vectors_to_matrix(part["_qv"]))
                for qid, qv, own in zip(part["_qid"].tolist(), part["_qv"], choose(distance, angle, part), strict=True):
                    for block, clusters in blocks.route(own).items():
                        for name, v in zip(out, (qid, block, clusters, qv), strict=True):
                            out[name].append(v)
                if out["_qid"]:
                    yield pd.DataFrame(out)

    path = run_folder(q.sparkSession, "probes")
    if choose is None:
        every = F.array(*[F.lit(b).cast("int") for b in blocks.route(np.arange(len(blocks.first)))])
        routed = (q.where(F.col("_qv").isNotNull())
                  .select("_qid", F.explode(every).alias("block"), F.array().cast("array<int>").alias("clusters"),
                          F.col("_qv").cast("array<double>").alias("_qv")))
    else:
        routed = q.mapInPandas(run, ROUTED)
    routed.write.parquet(path)
    return q.sparkSession.read.schema(ROUTED).parquet(path)


def _flat(column) -> tuple[np.ndarray, np.ndarray]:
    """(values, lengths) of an Arrow list column."""
    values, size = flat(column)
    return values.astype(np.float64, copy=False), size


def _score_blocks(k: int, exclude_self: bool):
    """Cogrouped rows and queries -> at most ``k`` rows a query: one running top-k over the clusters of the block."""
    import pyarrow as pa

    target = pa.schema([("query_id", pa.int64()), ("id", pa.int64()), ("distance", pa.float64())])

    def score(corpus, queries):
        if not corpus.num_rows or not queries.num_rows:
            return target.empty_table()
        mat, ids, cluster = matrix(corpus["_cv"]), id_array(corpus["_cid"]), np.asarray(corpus["cluster"])
        probed, count = flat(queries["clusters"])
        asking = np.repeat(np.arange(len(count)), count)
        by_cluster, by_probe = np.argsort(cluster, kind="stable"), np.argsort(probed, kind="stable")
        cluster, probed = cluster[by_cluster], probed[by_probe]
        acc = TopKAccumulator(id_array(queries["_qid"]), matrix(queries["_qv"]), k, exclude_self)
        starts, _ = runs(cluster)
        for lo, hi in zip(starts, np.append(starts[1:], len(cluster)), strict=True):
            first, last = np.searchsorted(probed, [cluster[lo], cluster[lo] + 1])
            if first < last:
                own = by_cluster[lo:hi]
                acc.add(ids[own], mat[own], asking[by_probe[first:last]])
        return pa.Table.from_arrays([pa.array(x) for x in acc.found()], schema=target)

    return score


def _cluster_rows(index: IvfIndex) -> dict[int, int]:
    """Rows per cluster; on a persisted index this reads parquet footers only."""
    if index.cluster_sizes is None:
        index.cluster_sizes = {r["cluster"]: r["n"] for r in index.assigned.groupBy("cluster")
                               .agg(F.count(F.lit(1)).alias("n")).collect()}
    return index.cluster_sizes


def _scan_plan(spark: SparkSession, rows: DataFrame, id_col: str, routed: DataFrame, blocks: Blocks,
               max_group_queries: int, every: bool = False) -> tuple[DataFrame, DataFrame]:
    """``rows`` (with ``cluster``) and routed queries, each with the (block, qsub) groups they meet in.

    ``every`` says that all queries ask for all clusters.
    """
    load = {r["block"]: r["n"] for r in routed.groupBy("block").agg(F.count(F.lit(1)).alias("n")).collect()}
    if every:
        probed = set(range(len(blocks.first)))
    else:
        probed = {r["c"] for r in routed.select(F.explode("clusters").alias("c")).distinct().collect()}
    # few blocks are split by query as well, so that all cores work
    cores = spark.sparkContext.defaultParallelism
    spread = math.ceil(cores / max(1, len(load)))
    parts = [(b, max(math.ceil(n / max_group_queries), min(spread, math.ceil(n / 64)))) for b, n in load.items()]
    # one row per probed cluster and per block (bounded by the centroids, which fit the broadcast bound)
    where = [(c, int(blocks.first[c]), int(blocks.splits[c])) for c in sorted(probed)]
    clusters = F.broadcast(spark.createDataFrame(where, "cluster int, first int, splits int"))
    split = F.broadcast(spark.createDataFrame(parts, "block int, qsplit int"))
    # the join with the probed clusters prunes the cluster=... folders of a persisted index
    corpus = (rows.join(clusters, "cluster")
              .withColumn("block", (F.col("first") + F.pmod(F.xxhash64(id_col), F.col("splits"))).cast("int"))
              .join(split, "block").withColumn("qsub", F.explode(F.sequence(F.lit(0), F.col("qsplit") - 1)))
              .select("block", "qsub", *rows.columns))
    asked = (routed.join(split, "block").withColumn("qsub", F.pmod(F.xxhash64("_qid"), F.col("qsplit")).cast("int"))
             .select("block", "qsub", "_qid", "clusters", "_qv"))
    return corpus, asked


def _scan(spark: SparkSession, index: IvfIndex, routed: DataFrame, blocks: Blocks, k: int, exclude_self: bool,
          max_group_queries: int) -> DataFrame:
    """Candidates (query_id, id, distance) of the routed queries: k a query and block."""
    rows = (index.assigned.select("cluster", F.col(index.id_col).cast("long").alias("_cid"), F.col(index.vec_col).alias("_cv"))
            .where(F.col("_cv").isNotNull()))
    corpus, asked = _scan_plan(spark, rows, "_cid", routed, blocks, max_group_queries)
    return (corpus.groupBy("block", "qsub").cogroup(asked.groupBy("block", "qsub"))
            .applyInArrow(_score_blocks(k, exclude_self), "query_id long, id long, distance double"))


def _checked(spark: SparkSession, index: IvfIndex):
    n_clusters = index.centroids.shape[0]
    if index.centroids.nbytes > broadcast_limit(spark):
        raise ValueError(f"{n_clusters} centroids ({index.centroids.nbytes} bytes) exceed the broadcast bound "
                         "spark.kbforge.broadcast.maxBytes; use fewer clusters or raise the bound")
    return spark.sparkContext.broadcast(index.centroids)


_EMPTY = "query_id long, rank int, id long, distance double"


def ivf_search(spark: SparkSession, index: IvfIndex, queries: DataFrame, k: int = 5, nprobe: int = 1,
               query_id: str = "query_id", query_vec: str = "embedding", exclude_self: bool = False,
               max_group_rows: int | None = None,
               max_group_queries: int = DEFAULT_MAX_GROUP_QUERIES) -> DataFrame:
    """Long result (query_id, rank, id, distance) like :func:`knn.knn_search`."""
    n_clusters = index.centroids.shape[0]
    nprobe = max(1, min(nprobe, n_clusters))
    bc = _checked(spark, index)
    q = queries.select(F.col(query_id).cast("long").alias("_qid"), F.col(query_vec).alias("_qv"))
    blocks = Blocks(_cluster_rows(index), n_clusters, max_group_rows or block_rows(spark, index.centroids.shape[1]))

    def nearest(distance, angle, part):
        cols, sel, _ = topk_columns(distance, np.arange(n_clusters), nprobe)
        return np.split(sel, np.searchsorted(cols, np.arange(1, len(part))))

    routed = _routed(q, bc, blocks, nearest)
    if not routed.take(1):
        return spark.createDataFrame([], _EMPTY)
    cands = _scan(spark, index, routed, blocks, k, exclude_self, max_group_queries)
    return rank_topk(cands, k).select("query_id", "rank", "id", "distance")


def measure_radii(index: IvfIndex) -> np.ndarray:
    """The largest angle between a row and its centroid, by cluster (one row a cluster is collected)."""
    spark = index.assigned.sparkSession
    bc = _checked(spark, index)

    def largest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        centers = bc.value
        most = np.full(len(centers), -1.0)
        for pdf in batches:
            pdf = pdf[pdf["_cv"].notna()]
            if len(pdf):
                mat, own = _vectors_to_matrix(pdf["_cv"]), pdf["cluster"].to_numpy()
                norm = np.linalg.norm(mat, axis=1)
                sim = (mat * centers[own]).sum(axis=1) / np.where(norm > 0, norm, 1)
                np.maximum.at(most, own, np.arccos(np.clip(sim, -1, 1)))
        met = np.flatnonzero(most >= 0)
        yield pd.DataFrame({"cluster": met.astype(np.int32), "radius": most[met]})

    rows = (index.assigned.select(F.col(index.vec_col).alias("_cv"), "cluster").mapInPandas(largest, "cluster int, radius double")
            .groupBy("cluster").agg(F.max("radius").alias("radius")).collect())
    out = np.zeros(len(index.centroids))
    for c, radius in rows:
        out[c] = radius
    return out


ROUNDING = 1e-7     # angles are compared with this much to spare, so rounding loses nothing


def pruned_search(spark: SparkSession, index: IvfIndex, queries: DataFrame, k: int = 5, first: int = 2,
                  query_id: str = "query_id", query_vec: str = "embedding", exclude_self: bool = False,
                  max_group_rows: int | None = None, max_group_queries: int = DEFAULT_MAX_GROUP_QUERIES,
                  measured: dict | None = None) -> DataFrame:
    """The exact k nearest of every query (as :func:`knn.knn_search`), visiting only clusters that can hold one.

    ``measured`` is given the number of (query, cluster) pairs and of those visited.
    Index rows and queries without a direction (all zero) are at distance 1 of
    everything, which no angle bounds: such a query visits all clusters, and clusters
    that hold such a row are always visited.
    """
    n_clusters = index.centroids.shape[0]
    bc = _checked(spark, index)
    if index.radii is None:
        index.radii = measure_radii(index)
    zero = F.aggregate(F.col(index.vec_col), F.lit(0.0), lambda a, x: a + F.abs(x.cast("double"))) == 0
    always = np.zeros(n_clusters, bool)
    always[[r["cluster"] for r in index.assigned.where(zero).select("cluster").distinct().collect()]] = True
    radii = index.radii
    q = queries.select(F.col(query_id).cast("long").alias("_qid"), F.col(query_vec).alias("_qv"))
    blocks = Blocks(_cluster_rows(index), n_clusters, max_group_rows or block_rows(spark, index.centroids.shape[1]))
    start = max(1, min(first, n_clusters))

    def nearest(distance, angle, part):
        cols, sel, _ = topk_columns(distance, np.arange(n_clusters), start)
        return np.split(sel, np.searchsorted(cols, np.arange(1, len(part))))

    def within(distance, angle, part):
        reach = np.arccos(np.clip(1.0 - part["_kth"].to_numpy(float), -1, 1)) + ROUNDING     # NaN: fewer than k found
        out = []
        for i, v in enumerate(part["_qv"]):
            can = always | ~(angle[:, i] - radii > reach[i]) if np.any(v) else np.ones(n_clusters, bool)
            can[topk_columns(distance[:, i:i + 1], np.arange(n_clusters), start)[1]] = False     # seen in the first round
            out.append(np.flatnonzero(can))
        return out

    routed = _routed(q, bc, blocks, nearest)
    if not routed.take(1):
        return spark.createDataFrame([], _EMPTY)
    path = run_folder(spark, "first-round")
    rank_topk(_scan(spark, index, routed, blocks, k, exclude_self, max_group_queries), k).write.parquet(path)
    hits = spark.read.parquet(path)
    kth = hits.where(F.col("rank") == k).select(F.col("query_id").alias("_k"), F.col("distance").alias("_kth"))
    second = _routed(q.join(kth, F.col("_qid") == F.col("_k"), "left").select("_qid", "_qv", "_kth"), bc, blocks, within)
    if measured is not None:
        pairs = lambda df: df.select(F.explode("clusters").alias("c"), "_qid").distinct().count()
        measured["pairs"] = n_clusters * q.where(F.col("_qv").isNotNull()).count()
        measured["visited"] = pairs(routed) + pairs(second)
    found = hits.select("query_id", "id", "distance")
    if second.take(1):
        found = found.unionByName(_scan(spark, index, second, blocks, k, exclude_self, max_group_queries))
    return rank_topk(found, k).select("query_id", "rank", "id", "distance")


def choose_nprobe(spark: SparkSession, index: IvfIndex, queries: DataFrame, k: int = 5, recall: float = TARGET_RECALL,
                  query_id: str = "query_id", query_vec: str = "embedding", exclude_self: bool = False,
                  sample_rows: int = SAMPLE_QUERIES) -> int:
    """The fewest probes with which a sample of the queries finds ``recall`` of its exact neighbours.

    The sample is the ``sample_rows`` queries with the smallest seeded hash of their id.  Its exact
    neighbours come from :func:`knn.knn_search` over the whole index; a neighbour is found with as
    many probes as the place of its cluster among the query's nearest centroids.
    """
    n_clusters = index.centroids.shape[0]
    qid, qv = F.col(query_id).cast("long").alias("query_id"), F.col(query_vec).alias("_qv")
    sample = (queries.select(qid, qv).where(F.col("query_id").isNotNull() & F.col("_qv").isNotNull())
              .orderBy(F.xxhash64(F.lit("nprobe"), F.col("query_id")), "query_id").limit(sample_rows))
    checkpoint_dir(spark)
    sample = sample.checkpoint(eager=True)
    true = knn_search(spark, index.assigned, sample, k, corpus_id=index.id_col, corpus_vec=index.vec_col,
                      query_vec="_qv", exclude_self=exclude_self)
    owners = index.assigned.select(F.col(index.id_col).alias("id"), "cluster")
    # at most sample_rows * k pairs and sample_rows vectors come to the driver
    pairs = true.select("query_id", "id").join(owners, "id").select("query_id", "cluster").collect()
    vectors = {r["query_id"]: r["_qv"] for r in sample.collect()}
    if not pairs:
        return n_clusters
    places = {}
    for i, v in vectors.items():
        order = np.argsort(-(index.centroids @ np.asarray(v, dtype=np.float64)), kind="stable")
        places[i] = np.argsort(order, kind="stable")
    needed = np.sort([int(places[r["query_id"]][r["cluster"]]) + 1 for r in pairs])
    return int(needed[min(len(needed), math.ceil(recall * len(needed))) - 1])


def recall_at_k(approx: DataFrame, exact: DataFrame) -> DataFrame:
    """Share of exact top-k ids also returned by the approximate search."""
    marks = approx.select("query_id", "id", F.lit(1).alias("_hit"))
    j = exact.select("query_id", "id").join(marks, ["query_id", "id"], "left")
    return j.agg((F.count("_hit") / F.count(F.lit(1))).alias("recall"))


__all__ = ["IvfIndex", "assign_ivf", "build_ivf", "choose_nprobe", "persist_ivf", "open_ivf", "ivf_search", "measure_radii",
           "pruned_search", "recall_at_k"]
