"""Registered vector queries (VEC-1 ... VEC-6, JOIN-4/5, STR-6, AGG-7)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as TX
from ..functions.vectors import DEFAULT_DIM, HashingEmbedder, cosine_distance
from ..operators.collection import duplicate_ids
from ..operators.ivf import build_ivf, ivf_search
from ..operators.knn import knn_search, zip_results
from ..session import broadcast_limit, run_folder, spread
from . import adapters as A
from . import sqltext as S
from .flagship import _sql_flagship_ctes, flagship_answers
from .registry import LIST_SEP, register

K = 5
IVF_CLUSTERS = 8


@register("vec1_hash_embedding", f"""
WITH {S.sparse_vectors('d', 'documents', 'doc_id', 'text', DEFAULT_DIM)}
SELECT key AS doc_id, CAST(b AS INTEGER) AS bucket, CAST(c AS DOUBLE) AS weight FROM d_vec""")
def vec1(spark: SparkSession, sf: str) -> DataFrame:
    docs = spread(A.table(spark, sf, "documents").select("doc_id", "text"))
    d = HashingEmbedder(DEFAULT_DIM).embed(docs, "text")
    nz = F.filter(F.transform("embedding", lambda w, i: F.struct(i.alias("bucket"), w.alias("weight"))),
                  lambda x: x["weight"] > 0)
    e = d.select("doc_id", F.explode(nz).alias("x"))
    return e.select("doc_id", F.col("x.bucket").cast("int").alias("bucket"), F.col("x.weight").alias("weight"))


_SQL_EMB = "e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"


def _sql_cos(a: str, b: str) -> str:
    return (f"CASE WHEN list_dot_product({b}, {b}) * list_dot_product({a}, {a}) = 0 THEN 1.0 "
            f"ELSE 1.0 - list_dot_product({b}, {a}) / sqrt(list_dot_product({b}, {b}) * list_dot_product({a}, {a})) END")


@register("vec2_cosine_next_vector", f"""
WITH {_SQL_EMB}
SELECT a.vec_id, round({_sql_cos('a.v', 'b.v')}, 6) AS distance FROM e a JOIN e b ON b.vec_id = a.vec_id + 1""")
def vec2(spark: SparkSession, sf: str) -> DataFrame:
    e = A.table(spark, sf, "embeddings")
    a, b = e.alias("a"), e.alias("b")
    j = a.join(b, F.col("b.vec_id") == F.col("a.vec_id") + 1)
    return j.select(F.col("a.vec_id"), F.round(cosine_distance(F.col("a.embedding"), F.col("b.embedding")), 6).alias("distance"))


_SQL_KNN_EMB = f"""
WITH {_SQL_EMB},
d AS (SELECT a.vec_id AS query_id, b.vec_id AS id, {_sql_cos('a.v', 'b.v')} AS distance
      FROM e a JOIN e b ON a.vec_id <> b.vec_id),
hits AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM d)
"""


def _emb_knn(spark, sf):
    e = A.table(spark, sf, "embeddings")
    return knn_search(spark, e, e, K, corpus_id="vec_id", corpus_vec="embedding",
                      query_id="vec_id", query_vec="embedding", exclude_self=True)


@register("vec3_knn_embeddings", _SQL_KNN_EMB +
          f"SELECT query_id, CAST(rank AS BIGINT) AS rank, id, round(distance, 6) AS distance FROM hits WHERE rank <= {K}")
def vec3(spark: SparkSession, sf: str) -> DataFrame:
    """VEC-3 / JOIN-4 / WIN-1 / TOP-2: every vector against all others, 5 nearest."""
    h = _emb_knn(spark, sf)
    return h.select("query_id", F.col("rank").cast("long"), "id", F.round("distance", 6).alias("distance"))


@register("join5_zip_results", _SQL_KNN_EMB +
          f"SELECT query_id, string_agg(CAST(id AS VARCHAR), {S.q(LIST_SEP)} ORDER BY rank) AS ids FROM hits "
          f"WHERE rank <= {K} GROUP BY query_id")
def join5(spark: SparkSession, sf: str) -> DataFrame:
    z = zip_results(_emb_knn(spark, sf))
    return z.select("query_id", F.array_join(F.transform("ids", lambda x: x.cast("string")), LIST_SEP).alias("ids"))


@register("vec4_ivf_full_probe", _SQL_KNN_EMB +
          f"SELECT query_id, CAST(rank AS BIGINT) AS rank, id, round(distance, 6) AS distance FROM hits WHERE rank <= {K}")
def vec4(spark: SparkSession, sf: str) -> DataFrame:
    """VEC-4 with nprobe = all clusters: must equal the exact search."""
    e = A.table(spark, sf, "embeddings")
    idx = build_ivf(e, IVF_CLUSTERS, id_col="vec_id", vec_col="embedding")
    h = ivf_search(spark, idx, e, K, nprobe=IVF_CLUSTERS, query_id="vec_id", query_vec="embedding",
                   exclude_self=True)
    return h.select("query_id", F.col("rank").cast("long"), "id", F.round("distance", 6).alias("distance"))


@register("vec3_knn_benchmark_in_documents", f"""
WITH {S.sparse_vectors('d', 'documents', 'doc_id', 'text', DEFAULT_DIM)},
{S.sparse_vectors('qq', 'benchmark', 'item_id', 'text', DEFAULT_DIM)},
{S.knn_sparse('qq', 'd', K)}
SELECT query_id, CAST(rank AS BIGINT) AS rank, key AS doc_id, round(distance, 6) AS distance FROM hits""")
def vec3_docs(spark: SparkSession, sf: str) -> DataFrame:
    """Benchmark passages as questions against the documents corpus (hashed vectors)."""
    emb = HashingEmbedder(DEFAULT_DIM)
    docs = emb.embed(spread(A.table(spark, sf, "documents").select("doc_id", "text")), "text")
    qs = emb.embed(spread(A.table(spark, sf, "benchmark").select("item_id", "text")), "text")
    h = knn_search(spark, docs, qs, K, corpus_id="doc_id", query_id="item_id")
    return h.select("query_id", F.col("rank").cast("long"), F.col("id").alias("doc_id"),
                    F.round("distance", 6).alias("distance"))


@register("str6_relevance", "WITH " + _sql_flagship_ctes()[len("WITH "):] + f"""
 SELECT query_id, CAST(rank AS BIGINT) AS rank, round((1.0 - distance) * 100.0, 6) AS relevance,
        {S.fixed1('(1.0 - distance) * 100.0')} || '%' AS relevance_text FROM hits""")
def str6(spark: SparkSession, sf: str) -> DataFrame:
    """STR-6: relevance percent (numeric and one-decimal text) of every retrieved result."""
    h = flagship_answers(spark, sf)["hits"]
    rel = TX.relevance_pct(F.col("distance"))
    return h.select("query_id", F.col("rank").cast("long"), F.round(rel, 6).alias("relevance"),
                    F.concat(TX.fixed1(rel), F.lit("%")).alias("relevance_text"))


@register("agg7_index_size", "SELECT CAST(count(*) AS BIGINT) AS index_size FROM embeddings")
def agg7(spark: SparkSession, sf: str) -> DataFrame:
    return A.table(spark, sf, "embeddings").agg(F.count(F.lit(1)).cast("long").alias("index_size"))


@register("vec6_duplicate_ids", """
SELECT conv_id AS id, CAST(count(*) AS BIGINT) AS n FROM conversations GROUP BY conv_id HAVING count(*) > 1""")
def vec6(spark: SparkSession, sf: str) -> DataFrame:
    c = A.table(spark, sf, "conversations").select(F.col("conv_id").alias("id"))
    return duplicate_ids(c, "id").select("id", F.col("n").cast("long"))


@register("vec4_ivf_persisted_full_probe", _SQL_KNN_EMB +
          f"SELECT query_id, CAST(rank AS BIGINT) AS rank, id, round(distance, 6) AS distance FROM hits WHERE rank <= {K}")
def vec4_persisted(spark: SparkSession, sf: str) -> DataFrame:
    """VEC-4 over the persisted ``cluster=`` layout (probed clusters only are read)."""
    from ..operators.ivf import persist_ivf
    path = run_folder(spark, "ivf")
    e = A.table(spark, sf, "embeddings")
    idx = persist_ivf(spark, build_ivf(e, IVF_CLUSTERS, id_col="vec_id", vec_col="embedding"), path)
    h = ivf_search(spark, idx, e, K, nprobe=IVF_CLUSTERS, query_id="vec_id", query_vec="embedding",
                   exclude_self=True)
    return h.select("query_id", F.col("rank").cast("long"), "id", F.round("distance", 6).alias("distance"))


@register("agg7_collection_size", "SELECT CAST(count(*) AS BIGINT) AS index_size FROM documents")
def agg7_collection(spark: SparkSession, sf: str) -> DataFrame:
    """AGG-7 on a committed collection built from the documents table, opened by name (VEC-5)."""
    from ..operators.collection import build_collection, collection_path, open_collection_by_name
    root = run_folder(spark, "run")
    docs = A.table(spark, sf, "documents").select(
        F.col("doc_id").alias("key"), F.col("doc_id").cast("string").alias("id"), F.col("text").alias("document"))
    meta = F.struct(F.lit(None).cast("string").alias("title"), F.lit(None).cast("int").alias("question_score"),
                    F.lit(None).cast("int").alias("answer_score"))
    recs = HashingEmbedder(DEFAULT_DIM).embed(docs, "document").withColumn("meta", meta)
    build_collection(spark, recs, collection_path(root, "documents"), name="documents")
    return open_collection_by_name(spark, root, "documents").agg(
        F.count(F.lit(1)).cast("long").alias("index_size"))


PROBE_STEP, PROBES = 25, 3


@register("vec4_ivf_pruned", f"""
WITH {_SQL_EMB},
c AS (SELECT vec_id, v, row_number() OVER (ORDER BY vec_id) - 1 AS cluster FROM e WHERE vec_id % {PROBE_STEP} = 0),
near AS (SELECT e.vec_id, c.cluster, row_number() OVER (PARTITION BY e.vec_id ORDER BY
         round(list_dot_product(e.v, c.v) / sqrt(list_dot_product(c.v, c.v) * list_dot_product(e.v, e.v)), 9) DESC, c.cluster) AS r
         FROM e, c),
d AS (SELECT q.vec_id AS query_id, b.vec_id AS id, {_sql_cos('q.v', 'b.v')} AS distance
      FROM near p JOIN near a ON a.cluster = p.cluster AND a.r = 1 AND p.r <= {PROBES} AND a.vec_id <> p.vec_id
      JOIN e q ON q.vec_id = p.vec_id JOIN e b ON b.vec_id = a.vec_id),
hits AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM d)
SELECT query_id, CAST(rank AS BIGINT) AS rank, id, round(distance, 6) AS distance FROM hits WHERE rank <= {K}""")
def vec4_pruned(spark: SparkSession, sf: str) -> DataFrame:
    """Probing and scoring of given clusters, row by row against the oracle; not a search to use.

    Every 25th vector is a centroid and three clusters are probed, so the oracle can compute the
    probes by itself; most true neighbours are missed.  :func:`vec4_recall` chooses its probes.
    """
    from ..operators.ivf import assign_ivf, persist_ivf
    e = A.table(spark, sf, "embeddings")
    rows = e.where(F.col("vec_id") % PROBE_STEP == 0)
    size = rows.agg(F.sum(F.size("embedding"))).first()[0] or 0
    if 8 * size > broadcast_limit(spark):        # before any vector comes to the driver
        raise ValueError(f"{8 * size} bytes of centroids exceed spark.kbforge.broadcast.maxBytes; "
                         "vec4_ivf_recall bounds their number")
    seeds = rows.orderBy("vec_id").collect()
    centroids = np.array([r["embedding"] for r in seeds], dtype=np.float64)
    path = run_folder(spark, "ivf")
    idx = persist_ivf(spark, assign_ivf(e, centroids, "vec_id", "embedding"), path)
    h = ivf_search(spark, idx, e, K, nprobe=PROBES, query_id="vec_id", query_vec="embedding", exclude_self=True)
    return h.select("query_id", F.col("rank").cast("long"), "id", F.round("distance", 6).alias("distance"))


@register("vec4_ivf_recall", None)
def vec4_recall(spark: SparkSession, sf: str) -> DataFrame:
    """VEC-4 with as few probes as a recall of 0.9 needs, over a persisted index.

    The number of centroids follows the corpus and is bounded (:func:`cluster_count`); the probes
    are measured on a sample of the queries (:func:`choose_nprobe`).
    """
    from ..operators.ivf import choose_nprobe, persist_ivf
    e = A.table(spark, sf, "embeddings")
    idx = persist_ivf(spark, build_ivf(e, id_col="vec_id", vec_col="embedding"), run_folder(spark, "ivf"))
    nprobe = choose_nprobe(spark, idx, e, K, query_id="vec_id", exclude_self=True)
    h = ivf_search(spark, idx, e, K, nprobe=nprobe, query_id="vec_id", query_vec="embedding", exclude_self=True)
    return h.select("query_id", F.col("rank").cast("long"), "id", F.round("distance", 6).alias("distance"))


def _document_records(docs: DataFrame) -> DataFrame:
    meta = F.struct(F.lit(None).cast("string").alias("title"), F.lit(None).cast("int").alias("question_score"),
                    F.lit(None).cast("int").alias("answer_score"))
    recs = docs.select(F.col("doc_id").alias("key"), F.col("doc_id").cast("string").alias("id"),
                       F.col("text").alias("document"))
    return HashingEmbedder(DEFAULT_DIM).embed(recs, "document").withColumn("meta", meta)


@register("vec6_add_records", """
SELECT doc_id AS key, CAST(doc_id AS VARCHAR) AS id, md5(text) AS digest FROM documents""")
def vec6_add(spark: SparkSession, sf: str) -> DataFrame:
    """VEC-6: a collection built from the even documents, the odd ones added: the whole table."""
    from ..operators.collection import add_records, build_collection, open_collection
    path = run_folder(spark, "add")
    docs = A.table(spark, sf, "documents").select("doc_id", "text")
    build_collection(spark, _document_records(docs.where("doc_id % 2 = 0")), path)
    add_records(spark, _document_records(docs.where("doc_id % 2 <> 0")), path)
    return open_collection(spark, path).select("key", "id", F.md5(F.col("document").cast("binary")).alias("digest"))


@register("agg7_index_size_states", """
SELECT 'absent' AS state, CAST(-1 AS BIGINT) AS index_size
UNION ALL SELECT 'built', CAST(count(*) AS BIGINT) FROM documents""")
def agg7_states(spark: SparkSession, sf: str) -> DataFrame:
    """AGG-7: -1 while there is no committed collection, then its number of records."""
    from ..operators.collection import build_collection, index_size
    path = run_folder(spark, "size")
    absent = index_size(spark, path)
    build_collection(spark, _document_records(A.table(spark, sf, "documents").select("doc_id", "text")), path)
    return spark.createDataFrame([("absent", absent), ("built", index_size(spark, path))],
                                 "state string, index_size long")


@register("vec4_ivfpq_recall", None)
def vec4_ivfpq(spark: SparkSession, sf: str) -> DataFrame:
    """VEC-4 with compressed codes: all codes are scanned, the vectors of a short list are read."""
    from ..operators.ivfpq import build_ivfpq, choose_shortlist, ivfpq_search
    e = A.table(spark, sf, "embeddings")
    idx = build_ivfpq(build_ivf(e, id_col="vec_id", vec_col="embedding"), run_folder(spark, "ivfpq"))
    size = choose_shortlist(spark, idx, e, K, query_id="vec_id", exclude_self=True)
    h = ivfpq_search(spark, idx, e, K, shortlist=size, query_id="vec_id", query_vec="embedding", exclude_self=True)
    return h.select("query_id", F.col("rank").cast("long"), "id", F.round("distance", 6).alias("distance"))


@register("vec4_pruned_exact", _SQL_KNN_EMB +
          f"SELECT query_id, CAST(rank AS BIGINT) AS rank, id, round(distance, 6) AS distance FROM hits WHERE rank <= {K}")
def vec4_pruned_exact(spark: SparkSession, sf: str) -> DataFrame:
    """VEC-3 over clusters: exact, without the clusters that the triangle inequality rules out."""
    from ..operators.ivf import persist_ivf, pruned_search
    e = A.table(spark, sf, "embeddings")
    idx = persist_ivf(spark, build_ivf(e, id_col="vec_id", vec_col="embedding"), run_folder(spark, "ivf"))
    h = pruned_search(spark, idx, e, K, query_id="vec_id", query_vec="embedding", exclude_self=True)
    return h.select("query_id", F.col("rank").cast("long"), "id", F.round("distance", 6).alias("distance"))


PQ_PARTS = 16


@register("vec4_pq_codes", f"""
WITH {_SQL_EMB},
u AS (SELECT vec_id, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM e),
p AS (SELECT vec_id, part, list_slice(v, CAST(part * 4 + 1 AS BIGINT), CAST(part * 4 + 4 AS BIGINT)) AS x
      FROM u, (SELECT unnest(range(0, {PQ_PARTS})) AS part)),
w AS (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS word, x FROM p WHERE vec_id % {PROBE_STEP} = 0
      QUALIFY word < 256),
near AS (SELECT p.vec_id, p.part, w.word, row_number() OVER (PARTITION BY p.vec_id, p.part ORDER BY
         round(list_dot_product(w.x, w.x) - 2 * list_dot_product(p.x, w.x), 12), w.word) AS r
         FROM p JOIN w ON p.part = w.part)
SELECT vec_id, CAST(part AS BIGINT) AS part, CAST(word AS BIGINT) AS word FROM near WHERE r = 1""")
def vec4_pq_codes(spark: SparkSession, sf: str) -> DataFrame:
    """Codes of all vectors, by piece, for given codebooks of 256 words (a byte) at most.

    The words are the pieces of every 25th vector, the first 256 of them, and there is no
    centroid, so that the oracle can code by itself; :func:`vec4_ivfpq` trains its codebooks.
    """
    from ..operators.ivfpq import CODEWORDS, pieces, unit_rows, write_codes
    e = A.table(spark, sf, "embeddings")
    rows = e.where(F.col("vec_id") % PROBE_STEP == 0).orderBy("vec_id").limit(CODEWORDS).collect()
    words = np.array([r["embedding"] for r in rows], dtype=np.float64)
    books = pieces(unit_rows(words), PQ_PARTS)
    one = e.select(F.col("vec_id").alias("id"), "embedding", F.lit(0).alias("cluster"))
    idx = write_codes(spark, one, np.zeros((1, words.shape[1])), books, run_folder(spark, "pq-codes"))
    byte = F.conv(F.substring(F.hex("code"), F.col("part") * 2 + 1, F.lit(2)), 16, 10).cast("long")
    return (idx.codes.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PQ_PARTS - 1))))
            .select(F.col("id").alias("vec_id"), F.col("part").cast("long").alias("part"), byte.alias("word")))
