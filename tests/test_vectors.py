"""VEC-1 .. VEC-6 and JOIN-4/5 against brute force and each other."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from kbforge.functions.vectors import HashingEmbedder
from kbforge.operators import collection as C
from kbforge.operators.ivf import build_ivf, ivf_search, recall_at_k
from kbforge.operators.knn import knn_search, topk_columns, unzip_results, zip_results

from conftest import SF01


def _brute(vecs, ids, k, exclude_self=True):
    m = np.asarray(vecs, dtype=np.float64)
    n2 = (m * m).sum(1)
    d = 1.0 - (m @ m.T) / np.sqrt(n2[:, None] * n2[None, :])
    out = {}
    for qi, q in enumerate(ids):
        order = sorted(((d[j, qi], ids[j]) for j in range(len(ids)) if not (exclude_self and ids[j] == q)))
        out[q] = [i for _, i in order[:k]]
    return out


def _emb(spark):
    return spark.read.parquet(f"{SF01}/embeddings.parquet")


def _hits_by_query(df):
    res = {}
    for r in df.orderBy("query_id", "rank").collect():
        res.setdefault(r["query_id"], []).append(r["id"])
    return res


def test_knn_equals_brute_force(spark):
    e = _emb(spark)
    rows = e.orderBy("vec_id").collect()
    expect = _brute([r["embedding"] for r in rows], [r["vec_id"] for r in rows], 5)
    got = _hits_by_query(knn_search(spark, e, e, 5, corpus_id="vec_id", query_id="vec_id", exclude_self=True))
    assert got == expect


def test_knn_invariant_under_repartition_and_blocks(spark):
    e = _emb(spark)
    base = _hits_by_query(knn_search(spark, e, e, 5, corpus_id="vec_id", query_id="vec_id", exclude_self=True))
    spark.conf.set("spark.kbforge.block.maxBytes", str(50_000))   # forces several blocks of both sides
    try:
        other = _hits_by_query(knn_search(spark, e.repartition(7), e, 5, corpus_id="vec_id", query_id="vec_id",
                                          exclude_self=True))
    finally:
        spark.conf.unset("spark.kbforge.block.maxBytes")
    assert other == base


def test_knn_one_kilobyte_blocks_and_two_level_merge(spark):
    e = _emb(spark).where("vec_id < 150")
    base = _hits_by_query(knn_search(spark, e, e, 5, corpus_id="vec_id", query_id="vec_id", exclude_self=True))
    tiny = _hits_by_query(knn_search(spark, e.repartition(9), e, 5, corpus_id="vec_id", query_id="vec_id",
                                     exclude_self=True, block_bytes=8192))
    assert tiny == base


def test_knn_brings_no_rows_to_the_driver(spark, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame as Classic

    e = _emb(spark)
    taken = []
    plain = Classic.collect

    def collect(self):
        rows = plain(self)
        taken.append(len(rows))
        return rows

    def refuse(self, *a, **k):
        raise AssertionError("rows through the driver")

    monkeypatch.setattr(Classic, "collect", collect)
    for name in ("toArrow", "toPandas", "toLocalIterator"):
        monkeypatch.setattr(Classic, name, refuse)
    knn_search(spark, e, e, 5, corpus_id="vec_id", query_id="vec_id", exclude_self=True).write.format("noop").mode(
        "overwrite").save()
    assert all(n <= 1 for n in taken)       # counts and the vector length only


def test_knn_fewer_than_k(spark):
    e = _emb(spark)
    small = e.where("vec_id < 3")
    h = knn_search(spark, small, e.where("vec_id = 10"), 5, corpus_id="vec_id", query_id="vec_id")
    assert h.count() == 3


def test_topk_columns_ties_by_id():
    d = np.array([[0.5], [0.1], [0.1], [0.9]])
    cols, ids, dist = topk_columns(d, np.array([7, 9, 3, 1]), 2)
    assert ids.tolist() == [3, 9]


def test_zip_unzip_round_trip(spark):
    e = _emb(spark)
    h = knn_search(spark, e, e, 5, corpus_id="vec_id", query_id="vec_id", exclude_self=True)
    back = unzip_results(zip_results(h))
    assert back.select("query_id", "rank", "id").exceptAll(h.select("query_id", "rank", "id")).count() == 0


def test_ivf_full_probe_is_exact_and_recall(spark):
    e = _emb(spark)
    idx = build_ivf(e, 8, id_col="vec_id")
    exact = knn_search(spark, e, e, 5, corpus_id="vec_id", query_id="vec_id", exclude_self=True)
    full = ivf_search(spark, idx, e, 5, nprobe=8, query_id="vec_id", exclude_self=True)
    assert _hits_by_query(full) == _hits_by_query(exact)
    part = ivf_search(spark, idx, e, 5, nprobe=2, query_id="vec_id", exclude_self=True, max_group_rows=40)
    r = recall_at_k(part, exact).first()["recall"]
    assert 0.0 < r <= 1.0


def test_ivf_persisted_layout(spark, tmp_dir):
    from kbforge.operators.ivf import persist_ivf
    e = _emb(spark)
    idx = persist_ivf(spark, build_ivf(e, 6, id_col="vec_id"), f"{tmp_dir}/ivf")
    exact = knn_search(spark, e, e, 5, corpus_id="vec_id", query_id="vec_id", exclude_self=True)
    full = ivf_search(spark, idx, e, 5, nprobe=6, query_id="vec_id", exclude_self=True)
    assert _hits_by_query(full) == _hits_by_query(exact)
    one = ivf_search(spark, idx, e.where("vec_id < 5"), 5, nprobe=1, query_id="vec_id")
    assert one.count() == 25


def test_ivf_hot_cluster_split_is_exact(spark):
    e = _emb(spark)
    idx = build_ivf(e, 4, id_col="vec_id")
    exact = knn_search(spark, e, e, 5, corpus_id="vec_id", query_id="vec_id", exclude_self=True)
    split = ivf_search(spark, idx, e, 5, nprobe=4, query_id="vec_id", exclude_self=True,
                       max_group_rows=25, max_group_queries=30)
    assert _hits_by_query(split) == _hits_by_query(exact)


def test_hash_embedding_counts(spark):
    df = spark.createDataFrame([(1, "a b a"), (2, ""), (3, None)], "id long, t string")
    rows = {r["id"]: r["embedding"] for r in HashingEmbedder(16).embed(df, "t").collect()}
    assert sum(rows[1]) == 3 and max(rows[1]) == 2
    assert sum(rows[2]) == 0


def _records(spark, n0, n1):
    return spark.range(n0, n1).select(
        F.col("id").alias("key"), F.col("id").cast("string").alias("id"), F.lit("doc").alias("document"),
        F.array(F.lit(1.0), F.col("id").cast("double")).alias("embedding"),
        F.struct(F.lit("t").alias("title"), F.lit(1).alias("question_score"), F.lit(1).alias("answer_score")).alias("meta"))


def test_collection_lifecycle(spark, tmp_dir):
    path = f"{tmp_dir}/coll"
    c = C.build_collection(spark, _records(spark, 0, 10), path, "qa")
    assert c.count() == 10 and C.index_size(spark, path) == 10
    assert C.collection_properties(spark, path)["space"] == "cosine"
    # skip: a committed collection is reused as is
    assert C.build_collection(spark, _records(spark, 0, 3), path, mode="skip").count() == 10
    with pytest.raises(FileExistsError):
        C.build_collection(spark, _records(spark, 0, 3), path, mode="error")
    assert C.build_collection(spark, _records(spark, 0, 3), path, mode="rebuild").count() == 3
    # keyed add: new ids append, repeated ids fail
    assert C.add_records(spark, _records(spark, 3, 6), path) == 3
    with pytest.raises(C.DuplicateIdError):
        C.add_records(spark, _records(spark, 5, 8), path)
    assert C.index_size(spark, f"{tmp_dir}/missing") == -1


def test_unfinished_collection_is_rebuilt(spark, tmp_dir):
    path = f"{tmp_dir}/half"
    _records(spark, 0, 4).write.parquet(f"{path}/v-unfinished")     # a build that ended before its commit
    assert C.index_size(spark, path) == -1
    assert C.build_collection(spark, _records(spark, 0, 7), path, mode="skip").count() == 7


def test_batch_model_embedder_plugs_into_search(spark):
    from kbforge.functions.vectors import BatchModelEmbedder

    def factory():
        def encode(texts):   # a stand-in "model": letter frequencies a..z
            out = np.zeros((len(texts), 26))
            for i, t in enumerate(texts):
                for ch in t.lower():
                    if "a" <= ch <= "z":
                        out[i, ord(ch) - 97] += 1
            return out
        return encode

    emb = BatchModelEmbedder(factory, 26)
    corpus = emb.embed(spark.createDataFrame([(1, "aaaa"), (2, "zzzz"), (3, "abab")], "id long, t string"), "t")
    qs = emb.embed(spark.createDataFrame([(10, "aaab")], "query_id long, t string"), "t")
    got = [r["id"] for r in knn_search(spark, corpus, qs, 2, dim=26).orderBy("rank").collect()]
    assert got == [1, 3]


def test_null_vectors_are_skipped(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.0, 1.0])], "id long, embedding array<double>")
    q = spark.createDataFrame([(9, [1.0, 0.1]), (8, None)], "query_id long, embedding array<double>")
    assert [r["id"] for r in knn_search(spark, df, q, 5).orderBy("rank").collect()] == [1, 3]


def test_bad_mode_changes_nothing_and_readers_keep_their_version(spark, tmp_dir):
    path = f"{tmp_dir}/coll"
    reader = C.build_collection(spark, _records(spark, 0, 3), path)
    with pytest.raises(ValueError):
        C.build_collection(spark, _records(spark, 0, 1), path, mode="sikp")
    assert C.index_size(spark, path) == 3
    with pytest.raises(C.DuplicateIdError):         # a failed rebuild leaves the old version current
        C.build_collection(spark, _records(spark, 0, 2).unionByName(_records(spark, 0, 2)), path, mode="rebuild")
    assert C.index_size(spark, path) == 3
    assert C.build_collection(spark, _records(spark, 0, 5), path, mode="rebuild").count() == 5
    assert reader.count() == 3                      # opened before the rebuild


def test_chosen_probes_reach_a_recall_of_nine_tenths(spark):
    from kbforge.operators.ivf import choose_nprobe
    from kbforge.plans import catalog
    from conftest import SF001

    for sf in (SF001, SF01):
        e = spark.read.parquet(f"{sf}/embeddings.parquet")
        exact = knn_search(spark, e, e, 5, corpus_id="vec_id", query_id="vec_id", exclude_self=True)
        got = catalog.REGISTRY["vec4_ivf_recall"][0](spark, sf)
        assert recall_at_k(got, exact).first()["recall"] >= 0.9
    # fewer probes than clusters, also from a small sample
    idx = build_ivf(e, id_col="vec_id")
    assert 1 <= choose_nprobe(spark, idx, e, 5, query_id="vec_id", exclude_self=True, sample_rows=100) < len(idx.centroids)


def test_a_codebook_past_the_bound_is_refused_before_it_is_collected(spark):
    from kbforge.plans import catalog
    spark.conf.set("spark.kbforge.broadcast.maxBytes", "64")
    try:
        with pytest.raises(ValueError, match="vec4_ivf_recall"):
            catalog.REGISTRY["vec4_ivf_pruned"][0](spark, SF01)
    finally:
        spark.conf.unset("spark.kbforge.broadcast.maxBytes")


def _clustered(spark, groups=12, size=40, dim=16, spread=0.05, seed=5):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(groups, dim))
    rows = [(g * size + i, [float(x) for x in centers[g] + spread * rng.normal(size=dim)])
            for g in range(groups) for i in range(size)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>")


def test_pruned_search_is_exact_and_skips_clusters(spark):
    from kbforge.operators.ivf import pruned_search
    e = _clustered(spark)
    exact = knn_search(spark, e, e, 5, corpus_id="vec_id", query_id="vec_id", exclude_self=True)
    idx, seen = build_ivf(e, 12, id_col="vec_id"), {}
    got = pruned_search(spark, idx, e, 5, query_id="vec_id", exclude_self=True, measured=seen)
    assert _hits_by_query(got) == _hits_by_query(exact)
    assert seen["pairs"] == 12 * 480 and seen["visited"] < 0.5 * seen["pairs"]
    # blocks of other sizes, and a first look that finds fewer than k
    small = pruned_search(spark, idx, e, 60, first=1, query_id="vec_id", max_group_rows=15, max_group_queries=100)
    assert _hits_by_query(small) == _hits_by_query(knn_search(spark, e, e, 60, corpus_id="vec_id", query_id="vec_id"))


def test_pruned_search_on_unclustered_vectors_zeros_and_nulls(spark):
    from kbforge.operators.ivf import assign_ivf, pruned_search
    e = _emb(spark).select("vec_id", "embedding").unionByName(spark.createDataFrame(
        [(9001, [0.0] * 64), (9002, None), (9003, [0.0] * 64)], "vec_id long, embedding array<float>"))
    centroids = np.array([r["embedding"] for r in e.where("vec_id % 23 = 0").orderBy("vec_id").collect()])
    exact = knn_search(spark, e, e, 5, corpus_id="vec_id", query_id="vec_id", exclude_self=True)
    got = pruned_search(spark, assign_ivf(e, centroids, "vec_id"), e, 5, query_id="vec_id", exclude_self=True)
    assert _hits_by_query(got) == _hits_by_query(exact)


def test_blocks_hold_all_clusters_and_split_large_ones():
    from kbforge.operators.ivf import Blocks
    b = Blocks({0: 5, 1: 5, 2: 40, 3: 1, 4: 9}, 6, 10)
    assert b.splits.tolist() == [1, 1, 4, 1, 1, 1]
    assert b.first.tolist() == [0, 0, 1, 5, 5, 6] and b.count == 7
    assert b.route(np.array([0, 1, 2, 5])) == {0: [0, 1], 1: [2], 2: [2], 3: [2], 4: [2], 6: [5]}


def test_codes_and_tables_give_the_products_of_the_coded_rows():
    from kbforge.operators import ivfpq as P
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 10))
    books = P.train_codebooks(x, 4, codewords=32)           # pieces of 3, the last one filled up
    codes = P.encode(x, books)
    coded = np.concatenate([books[p][codes[:, p]] for p in range(4)], axis=1)[:, :10]
    assert codes.shape == (600, 4) and ((x - coded) ** 2).sum() < 0.4 * (x ** 2).sum()
    for p, piece in enumerate(P.pieces(x, 4)):              # brute force over all words
        d = ((piece[:, None, :] - books[p][None]) ** 2).sum(axis=2)
        assert np.allclose(d[np.arange(600), codes[:, p]], d.min(axis=1))
    q = rng.normal(size=(5, 10))
    table = np.einsum("pqd,pwd->pqw", P.pieces(q, 4), books)
    assert np.allclose(sum(table[p][:, codes[:, p]] for p in range(4)), q @ coded.T)


def test_compressed_search_reaches_recall_from_a_tenth_of_the_vectors(spark, tmp_dir):
    from kbforge.operators.ivfpq import build_ivfpq, choose_shortlist, ivfpq_search
    e = spark.read.parquet(f"{SF01}/embeddings.parquet")
    n = e.count()
    exact = knn_search(spark, e, e, 5, corpus_id="vec_id", query_id="vec_id", exclude_self=True).cache()
    idx = build_ivfpq(build_ivf(e, id_col="vec_id"), f"{tmp_dir}/pq")
    assert {len(r.code) for r in idx.codes.collect()} == {16} and idx.codes.count() == n
    size = choose_shortlist(spark, idx, e, 5, query_id="vec_id", exclude_self=True)
    assert size <= n // 10
    got = ivfpq_search(spark, idx, e, 5, shortlist=size, query_id="vec_id", exclude_self=True)
    assert recall_at_k(got, exact).first()["recall"] >= 0.9
    # a list of everything, in small blocks, is the exact search
    full = ivfpq_search(spark, idx, e.where("vec_id < 40"), 5, shortlist=n, query_id="vec_id", exclude_self=True,
                        max_group_codes=60, max_group_queries=30)
    assert _hits_by_query(full) == _hits_by_query(exact.where("query_id < 40"))


def test_compressed_search_of_nulls_zeros_and_nothing(spark, tmp_dir):
    from kbforge.operators.ivf import assign_ivf
    from kbforge.operators.ivfpq import build_ivfpq, ivfpq_search
    rows = [(i, [float(i % 3), 1.0, float(i % 5)]) for i in range(30)] + [(50, [0.0] * 3), (51, None)]
    df = spark.createDataFrame(rows, "id long, embedding array<double>")
    idx = build_ivfpq(assign_ivf(df, np.eye(3)), f"{tmp_dir}/pq", parts=2)
    q = spark.createDataFrame([(1, [1.0, 1.0, 1.0]), (2, None), (3, [0.0] * 3)], "query_id long, embedding array<double>")
    got = ivfpq_search(spark, idx, q, 40, shortlist=100)
    want = knn_search(spark, df, q, 40)
    assert {(r.query_id, r.id, round(r.distance, 9)) for r in got.collect()} == {
        (r.query_id, r.id, round(r.distance, 9)) for r in want.collect()}
    assert ivfpq_search(spark, idx, q.where("query_id = 2"), 3).collect() == []


def test_paired_distances_are_those_of_the_expression(spark):
    from kbforge.functions.vectors import cosine_distance, paired_distances
    rng = np.random.default_rng(8)
    a, b = rng.normal(size=(2, 200, 17)).astype(np.float32)
    a[3], b[4], b[5], a[6] = 0, 0, a[5], 1e30
    b[6] = -a[6]
    rows = spark.createDataFrame([(i, x.tolist(), y.tolist()) for i, (x, y) in enumerate(zip(a, b))],
                                 "i int, a array<float>, b array<float>")
    want = [r.d for r in rows.select("i", cosine_distance(F.col("a"), F.col("b")).alias("d")).orderBy("i").collect()]
    assert paired_distances(a, b).tolist() == want


def test_queries_of_all_clusters_name_none(spark, tmp_dir):
    """a list of all clusters a query grows with the rows times their square root."""
    from kbforge.operators import ivf, ivfpq
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (None, [0.0, 1.0])], "_qid long, _qv array<float>")
    blocks = ivf.Blocks({0: 3, 1: 9, 2: 2, 3: 20}, 4, 10)
    routed = ivf._routed(q, None, blocks, None)
    named = set(blocks.route(np.arange(4)))
    assert sorted((str(r["_qid"]), r["block"], r["clusters"], r["_qv"]) for r in routed.collect()) == sorted(
        (str(i), b, [], v) for b in named for i, v in ((1, [1.0, 0.0]), (None, [0.0, 1.0])))
    rows = spark.createDataFrame([(i, i % 4) for i in range(40)], "id long, cluster int")
    codes, _ = ivf._scan_plan(spark, rows, "id", routed, blocks, 5_000, True)
    assert sorted({r["id"] for r in codes.collect()}) == list(range(40))
    assert ivfpq.group_queries(spark, 64, 160, 10) == 2_000
    assert 8_000 < ivfpq.group_queries(spark, 64, 160, 10**8) < 2**25 / (64 * 8 + 160 * 16)
