"""Findings of round 3: memory and work of the searches, the session histories and the replayed streams."""

from __future__ import annotations

import tracemalloc

import numpy as np
import pandas as pd
import pyarrow as pa

from kbforge.operators import ivf, ivfpq, knn

MB = 2 ** 20


class _Sent:
    def __init__(self, value):
        self.value = value


def _peak_mb(fn) -> float:
    tracemalloc.start()
    try:
        fn()
        return tracemalloc.get_traced_memory()[1] / MB
    finally:
        tracemalloc.stop()


def _vectors(column: str, ident: str, mat: np.ndarray, **more) -> pa.Table:
    rows = pa.ListArray.from_arrays(pa.array(np.arange(0, mat.size + 1, mat.shape[1]), pa.int32()), pa.array(mat.ravel()))
    return pa.table({ident: pa.array(np.arange(len(mat))), column: rows, **more})


def _brute(ids, mat, qids, q, k):
    d = 1.0 - (q @ mat.T) / np.sqrt((mat * mat).sum(1)[None, :] * (q * q).sum(1)[:, None])
    return [(int(i), int(ids[j])) for i, row in zip(qids, np.round(d, 10), strict=True)
            for j in [j for j in np.lexsort((ids, row)) if ids[j] != i][:k]]


def test_probe_memory_does_not_follow_the_centroids():
    """4,000 rows x 8,000 centroids were one matrix of 256 MB and several like it."""
    rng = np.random.default_rng(1)
    rows = pd.DataFrame({"_qid": np.arange(4000), "_qv": list(rng.normal(size=(4000, 8)))})
    centers = ivfpq.unit_rows(rng.normal(size=(8000, 8)))
    got = []
    peak = _peak_mb(lambda: got.extend(ivf._probe_fn(_Sent(centers), 1)([rows])))
    assert peak < 100, peak
    near = pd.concat(got).set_index("_qid")["cluster"]
    assert near.loc[:19].tolist() == [int(np.argmax(centers @ v)) for v in rows["_qv"][:20]]


def test_exact_search_scores_in_bounded_memory():
    """the cells of a chunk were kept in a dozen matrices of 32 MB."""
    rng = np.random.default_rng(2)
    mat = rng.normal(size=(20_000, 16))
    acc = knn.TopKAccumulator(np.arange(2000), mat[:2000], 5, True)
    peak = _peak_mb(lambda: acc.add(np.arange(20_000), mat))
    assert peak < 60, peak
    q, i, _ = acc.found()
    assert list(zip(q.tolist(), i.tolist(), strict=True))[:500] == _brute(np.arange(20_000), mat, np.arange(100), mat[:100], 5)


def test_copies_go_by_id_and_repeated_ids_leave_enough():
    rng = np.random.default_rng(3)
    mat = rng.integers(0, 3, (40, 6)).astype(float)[rng.integers(0, 40, 6000)] + 1.0
    ids = rng.permutation(6000) // 3            # every id three times
    acc = knn.TopKAccumulator(ids[:50], mat[:50], 5, True)
    acc.add(ids, mat)
    q, i, _ = acc.found()
    assert list(zip(q.tolist(), i.tolist(), strict=True)) == _brute(ids, mat, ids[:50], mat[:50], 5)


def test_pairs_of_blocks_are_tasks(spark):
    """F8: the groups of several pairs were put into one task."""
    rows = spark.range(3000).selectExpr("id as vec_id", "array(sin(id), cos(id), 1.0D) as embedding")
    found = knn.knn_candidates(spark, rows, rows, corpus_id="vec_id", query_id="vec_id", block_bytes=40 * 500)
    assert "REPARTITION_BY_NUM" in found._jdf.queryExecution().toString()


def test_block_of_many_clusters_keeps_one_list_a_query():
    """the block kept k rows per query and cluster until its end."""
    rng = np.random.default_rng(4)
    mat = rng.normal(size=(4000, 8))
    cluster = np.arange(4000) % 200
    corpus = _vectors("_cv", "_cid", mat, cluster=pa.array(cluster, pa.int32()))
    all_of_them = pa.array([list(range(200))] * 1500, pa.list_(pa.int32()))
    queries = _vectors("_qv", "_qid", mat[:1500], clusters=all_of_them)
    got = []
    peak = _peak_mb(lambda: got.append(ivf._score_blocks(5, True)(corpus, queries)))
    assert peak < 60, peak
    pairs = sorted(zip(*(got[0][c].to_pylist() for c in ("query_id", "distance", "id")), strict=True))[:500]
    assert [(q, i) for q, _, i in pairs] == _brute(np.arange(4000), mat, np.arange(100), mat[:100], 5)


def test_short_lists_are_those_of_the_looked_up_products():
    """codes are scored by matrix products; the lists are those of sums of products piece by piece."""
    rng = np.random.default_rng(5)
    centers, books = rng.normal(size=(3, 10)), rng.normal(size=(4, 256, 3)) / 4
    books[-1, :, 1:] = 0                        # the last piece is filled up: 10 = 3 * 3 + 1
    code, cluster = rng.integers(0, 256, (3000, 4)).astype(np.uint8), rng.integers(0, 3, 3000)
    codes = pa.table({"id": np.arange(3000), "cluster": pa.array(cluster, pa.int32()), "code": [c.tobytes() for c in code]})
    q = rng.normal(size=(30, 10))
    for probes in ([0, 1, 2], [0, 2]):
        asked = _vectors("_qv", "_qid", q, clusters=pa.array([probes] * 30, pa.list_(pa.int32())))
        got = ivfpq._short_lists(_Sent((centers, books)), 12, True)(codes, asked).to_pydict()
        unit = ivfpq.unit_rows(q)
        near = 1.0 - (unit @ centers.T)[:, cluster]
        for p, x in enumerate(ivfpq.pieces(unit, 4)):
            near -= (x @ books[p].T)[:, code[:, p]]
        near[:, ~np.isin(cluster, probes)] = np.inf
        near[np.arange(30), np.arange(30)] = np.inf
        want = np.argsort(near, axis=1, kind="stable")[:, :12]
        assert got["query_id"] == np.repeat(np.arange(30), 12).tolist() and got["id"] == want.ravel().tolist()
        assert np.allclose(got["near"], np.take_along_axis(near, want, 1).ravel())
    assert not hasattr(ivfpq, "CELLS")


class _State:
    def __init__(self, held=None):
        self.hasTimedOut, self.held = False, held

    exists = property(lambda self: self.held is not None)
    get = property(lambda self: self.held)

    def update(self, value):
        self.held = value


def test_history_update_makes_one_frame(monkeypatch):
    """a session made about ten frames a batch, for at most eight entries."""
    from kbforge.streaming import history_state as H

    chunks = [pd.DataFrame({"t": np.r_[np.arange(60), [59, 59]], "text": ["x"] * 60 + [None, "y"]}),
              pd.DataFrame({"t": [59, 3], "text": ["z", "late"]})]
    made, frame, state = [], pd.DataFrame, _State(([58], ["w"]))
    monkeypatch.setattr(H.pd, "DataFrame", lambda *a, **k: made.append(1) or frame(*a, **k))
    (out,) = H._update_fn(8, None)((7,), iter(chunks), state)
    assert list(zip(out["t"], out["text"], strict=True)) == [
        (59, "z"), (59, "y"), (59, "x"), (59, None), (58, "x"), (58, "w"), (57, "x"), (56, "x")]
    assert len(made) == 1 and state.held == (out["t"].tolist(), out["text"].tolist())
    assert out["pos"].tolist() == list(range(1, 9)) and set(out["session"]) == {7}
    (out,) = H._update_fn(8, None)((7,), iter([frame({"t": [5.0, np.nan], "text": ["a", "b"]})]), state := _State())
    assert state.held == ([5, None], ["a", "b"]) and out["t"].isna().tolist() == [False, True]


def test_replayed_ranges_are_dealt_in_one_pass(spark, tmp_path):
    """every file of the replay read, filtered and wrote the whole table in one task."""
    from pyspark.sql import functions as F

    from kbforge.plans import q_streaming as Q

    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    rows = spark.range(1000).select(F.timestamp_seconds(F.col("id") * 60).alias("at"), F.col("id").alias("user_id"))
    Q._in_time_order(rows.mapInArrow(count, rows.schema), "at", str(tmp_path / "in"))
    assert seen.value <= 3 * 1000       # edges, files, heartbeat
    files = sorted((p.stat().st_mtime_ns, str(p)) for p in (tmp_path / "in").glob("*.parquet"))
    firsts = [spark.read.parquet(p).agg(F.min("at")).first()[0] for _, p in files]
    assert len(files) == Q.REPLAY_FILES + 1 and firsts == sorted(firsts)
    assert spark.read.parquet(str(tmp_path / "in")).where("user_id >= 0").select("user_id").distinct().count() == 1000


def test_token_stage_remembers_few_units(monkeypatch, spark):
    """pipeline: 800,000 units a generation in every worker took the executor over its limit in token_ids."""
    from kbforge.llm import bitplanes as B
    from kbforge.llm import stages
    from kbforge.llm.queries import tokenizer_path

    asked = {}
    monkeypatch.setattr(stages.bitplanes, "write_ids", lambda *a, **k: asked.update(k))
    monkeypatch.setattr(stages.bitplanes, "read_digests", lambda *a: None)
    stages.token_ids(spark, None, "")
    assert asked["max_units"] <= 100_000
    few, many = B.encoder(tokenizer_path(), 50), B.encoder(tokenizer_path())
    text = " ".join(f"word{i % 700} and{i}" for i in range(3000))
    assert few is not many and few.encode(text) == many.encode(text)
    assert len(few.units) <= 50 and len(few.units.old) <= 50


def test_pieces_are_remembered_not_units():
    """op1: every new unit of known pieces ("word," "word." ...) was split, encoded and remembered by itself."""
    from kbforge.llm import bitplanes as B
    from kbforge.llm.queries import tokenizer_path

    e = B.UnitEncoder(tokenizer_path())
    asked, real = [], e.pieces.tokenize
    e.pieces.tokenize = lambda letters: asked.append(letters) or real(letters)
    words = [f"{a}{b}" for a in "red green blue".split() for b in "kiwi melon".split()]
    text = " ".join(f"{w}{mark}{v}" for w in words for v in words for mark in (".\n", ",", "-"))
    other = f"{text} 中 {text}"
    lib = lambda t: np.asarray(e.units.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes()
    assert e.encode(text) == lib(text) and not e.units
    assert len(asked) <= 2 * len(words) + 4
    assert e.encode(other) == lib(other)
    assert len(asked) <= 2 * len(words) + 4


def test_blocks_of_long_vectors_have_fewer_rows(spark):
    """50,000 rows a block whatever their length: 102 MB of 256 numbers each, and as much again in its copies."""
    assert ivf.block_rows(spark, 256) * 256 * 8 <= 32 * MB < 50_000 * 256 * 8
    assert ivf.block_rows(spark, 8) == ivf.DEFAULT_MAX_GROUP_ROWS and ivf.block_rows(spark, 10 ** 9) == 1
    rng = np.random.default_rng(7)
    mat = rng.normal(size=(60, 4))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(mat)], "vec_id long, embedding array<double>")
    idx = ivf.assign_ivf(rows, mat[:3], "vec_id", "embedding")
    spark.conf.set("spark.kbforge.block.maxBytes", str(10 * (8 * 4 + 16)))
    try:
        assert ivf.block_rows(spark, 4) == 10
        got = ivf.ivf_search(spark, idx, rows, 3, 3, query_id="vec_id", exclude_self=True).collect()
    finally:
        spark.conf.unset("spark.kbforge.block.maxBytes")
    assert [(r.query_id, r.id) for r in sorted(got)] == _brute(np.arange(60), mat, np.arange(60), mat, 3)


def test_length_of_a_vector_is_computed_once(spark):
    """it was computed anew for every number, so the work grew with the square of the length."""
    import time

    from pyspark.sql import functions as F

    odd = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],), (None,), ([1.0, None],), ([],)], "v array<float>")
    assert [r[0] for r in odd.select(ivf._unit(F.col("v"))).collect()] == [[0.6, 0.8], [0.0, 0.0], None, [0.0, 0.0], []]

    def seconds(dim: int) -> float:
        unit = ivf._unit(F.transform(F.sequence(F.lit(1), F.lit(dim)), lambda x: (x + F.col("id")).cast("double")))
        t = time.perf_counter()
        spark.range(0, 800_000 // dim, 1, 1).agg(F.max(F.aggregate(unit, F.lit(0.0), lambda a, x: a + x))).collect()
        return time.perf_counter() - t

    seconds(16)
    assert seconds(1024) < 6 * seconds(16)      # as many numbers; was 64 times the work of the short ones


def test_embedding_counts_a_bounded_part_of_a_batch():
    """the buckets of a whole batch of long texts were held three times, as 64-bit numbers."""
    from kbforge.functions import vectors

    rng = np.random.default_rng(8)
    rows = [rng.integers(0, 16, n).astype(np.int32) for n in [20_000] * 400 + [0, 1, 2_000_000]] + [None]
    got = []
    peak = _peak_mb(lambda: got.append(vectors._bincount_udf(16).func(pd.Series(rows))))
    assert peak < 80, peak
    assert got[0].iloc[-1] is None
    assert all(np.array_equal(v, np.bincount(r, minlength=16)) for r, v in zip(rows[:-1], got[0], strict=False))
