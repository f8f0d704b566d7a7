import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from kbforge.llm import stages, waterfill
from tests.llm.conftest import CLASHES, by_id


def loop_targets(sizes, weights=(3, 1, 2), budget=1.5, epochs=2):
    """The rule as it is told: clamp, share the excess again by weight, until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    left, free, out = budget * sum(sizes.values()), set(names), {}
    while free:
        share = left / sum(w[s] for s in free)
        over = [s for s in free if share * w[s] > epochs * sizes[s]]
        if not over:
            return out | {s: share * w[s] for s in free}
        for s in over:
            out[s] = float(epochs * sizes[s])
            left -= out[s]
            free.remove(s)
    return out


@pytest.mark.parametrize("sizes", [
    {"a": 100}, {"a": 0}, {"a": 5, "b": 1000, None: 7}, {"a": 10, "b": 10, "c": 10, "d": 1, "é": 500, "": 3, "Z": 90},
    {f"s{k}": (k * 37) % 101 for k in range(30)}, {"a": 0, "b": 0}, {"a": 1, "b": 10**12, "c": 3}])
def test_targets(spark, sizes):
    rows = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in waterfill.targets(rows).collect()}
    want = loop_targets(sizes)
    assert set(got) == set(want)
    for s, t in want.items():
        assert got[s] == pytest.approx(t, rel=1e-9, abs=1e-6)


def sql_rows(docs):
    documents = docs.select("doc_id", "text", "source").toPandas()  # noqa: F841  read by DuckDB
    documents["doc_id"] = documents["doc_id"].astype("Int64")
    con = duckdb.connect()
    con.register("documents", documents)
    return con.sql(waterfill.MIX_SQL).fetchall()


def test_mix_edge_rows(edge_docs, no_docs):
    got = [tuple(r) for r in waterfill.mix(edge_docs).select("doc_id", "size", "source_size", "target", "taken").collect()]
    key = lambda r: tuple(str(v) for v in r)
    assert sorted(got, key=key) == sorted(sql_rows(edge_docs), key=key)
    assert waterfill.mix(no_docs).collect() == [] and waterfill.repeated(no_docs).collect() == []


@pytest.mark.parametrize("ids", [lambda i: 5, lambda i: None, lambda i: i % 3])
def test_one_id_or_none_and_repeated_rows_come_near_the_target(spark, ids):
    rows = [(ids(i), " ".join(f"w{i % 4 if i < 200 else i}" for _ in range(100)), "a") for i in range(260)]
    rows += [(1000 + i, "one two three", "b") for i in range(3000)] + [(7, "x y z", "c")] * 2000
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(6)
    found = waterfill.mix(docs).collect()
    by_source = {}
    for r in found:
        t = by_source.setdefault(r.source, [r.target, 0])
        t[1] += r.taken
        assert 0 <= r.taken <= 2 * r.size
    for target, taken in by_source.values():
        assert abs(taken - target) <= 101
    key = lambda r: tuple(str(v) for v in r)
    columns = ["doc_id", "size", "source_size", "target", "taken"]
    assert sorted(map(key, ([r[c] for c in columns] for r in found))) == sorted(map(key, sql_rows(docs)))
    out = waterfill.repeated(docs.withColumn("extra", F.lit(1)))
    words = {r.source: r.n for r in out.groupBy("source").agg(F.sum(waterfill.size_of(F.col("text"))).alias("n")).collect()}
    assert words == {s: taken for s, (_, taken) in by_source.items()}


def test_mix_is_near_its_targets_and_repeats(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    docs = docs.withColumn("source", F.when(F.col("source") > "src3", F.col("source")))   # a hot null source
    rows = waterfill.mix(docs).collect()
    by_source = {}
    for r in rows:
        t = by_source.setdefault(r.source, [r.target, 0, r.source_size, 0])
        t[1] += r.taken
        t[3] += r.size
        assert 0 <= r.taken <= 2 * r.size
    for target, taken, size, summed in by_source.values():
        assert abs(taken - target) <= 0.02 * target + 1 and size == summed and target <= 2 * size + 1e-6
    again = waterfill.mix(docs.repartition(5)).collect()
    assert sorted(map(str, again)) == sorted(map(str, rows))
    copies = {r.doc_id: r.copies for r in rows}
    out = waterfill.repeated(docs)
    assert out.columns == docs.columns
    assert {r["doc_id"]: r["count"] for r in out.groupBy("doc_id").count().collect()} == {d: c for d, c in copies.items() if c}


def test_stages_list():
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality_classifier", "simhash_near_dedup", "benchmark_decontamination", "mix_sources", "token_ids"]
    assert corpus_pipeline.ORACLE_SQL is None


def test_dedup_keeps_one_row_of_each_component(spark, edge_docs):
    from kbforge.llm.simhash_segments import near_duplicates

    out = stages.simhash_near_dedup(spark, edge_docs, "")
    assert out.columns == edge_docs.columns
    # a component is named by its root: two of them have the doc_id 7
    classes = {(r.root, r.component_id) for r in near_duplicates(edge_docs).collect()}
    rows = by_id([r.asDict() for r in out.collect()])
    assert len(rows) == len(classes)
    # texts without a word share one fingerprint; the repeated row of id 7 stays once, its other text too
    assert sorted(str(r["doc_id"]) for r in rows) == sorted(str(c) for _, c in classes)
    assert [r["doc_id"] for r in rows].count(7) == 2


def test_dedup_keeps_different_texts_of_one_id_and_without_an_id(spark):
    a = [f"alpha{k} beta{k}" for k in range(40)]
    b = [f"gamma{k} delta{k}" for k in range(40)]
    c = [f"omega{k} sigma{k}" for k in range(40)]
    a, b, c = (" ".join(x) for x in (a, b, c))
    schema = "doc_id long, text string, lang string, source string"
    kept = lambda rows: sorted((str(r.doc_id), r.text) for r in stages.simhash_near_dedup(
        spark, spark.createDataFrame([(i, t, "en", "s") for i, t in rows], schema), "").collect())
    # two texts without an id, one of them twice; a copy without an id of a document with one goes
    assert kept([(None, a), (None, b), (None, b), (4, c), (None, c)]) == sorted([("None", a), ("None", b), ("4", c)])
    # one id in two components, whichever text comes first
    assert kept([(3, a), (5, a), (5, b), (9, b)]) == [("3", a), ("5", b)]
    assert kept([(3, b), (5, b), (5, a), (9, a)]) == [("3", b), ("5", a)]
    assert kept([(7, a), (7, b), (7, b)]) == [("7", a), ("7", b)]


def test_pipeline_against_a_plain_version(spark):
    """Each stage of a small run against what its operator says, by plain set logic."""
    from kbforge.llm import rulefit, simhash_segments, tiling
    from kbforge.llm.common import save

    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    one = save(corpus_pipeline.STAGES[0][1](spark, docs, sf), "one")
    model = rulefit.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    good = {r.doc_id for r in rulefit.scores(docs, model).where("predicted = 1").collect()}
    assert {r.doc_id for r in one.collect()} == good and len(good) < docs.count()
    two = save(corpus_pipeline.STAGES[1][1](spark, one, sf), "two")
    assert {r.doc_id for r in two.collect()} == {r.component_id for r in simhash_segments.near_duplicates(one).collect()}
    three = save(corpus_pipeline.STAGES[2][1](spark, two, sf), "three")
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    leaks = {r.doc_id for r in tiling.contamination(two, bench).collect()}
    assert {r.doc_id for r in three.collect()} == {r.doc_id for r in two.collect()} - leaks and leaks
    four = save(corpus_pipeline.STAGES[3][1](spark, three, sf), "four")
    assert four.columns == docs.columns and four.count() == sum(r.copies for r in waterfill.mix(three).collect())
    five = corpus_pipeline.STAGES[4][1](spark, four, sf).collect()
    assert sorted(r.doc_id for r in five) == sorted(r.doc_id for r in four.select("doc_id").collect())
    whole = corpus_pipeline.run(spark, sf).collect()
    assert sorted(map(str, whole)) == sorted(map(str, five))


def test_pipeline_stages_on_edge_rows(spark, edge_docs, no_docs, tmp_path):
    sf = str(tmp_path)
    spark.createDataFrame([(7, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(1, "alpha beta gamma. alpha beta gamma. alpha beta")], "item_id long, text string").write.parquet(
        f"{sf}/benchmark.parquet")
    for docs in (edge_docs, no_docs):
        for k, (_name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
            out = stage(spark, docs, sf)
            assert out.columns == docs.columns
            rows = out.collect()
            assert (k == 3) or len(rows) <= docs.count()
        assert len(stages.token_ids(spark, docs, sf).collect()) == docs.count()
    assert CLASHES and stages.benchmark_decontamination(spark, edge_docs, sf).where("doc_id = 6").count() == 0


def test_near_dedup_sends_no_exploded_rows_to_the_driver(spark, tmp_dir, monkeypatch):
    """cells of fingerprints are 33 or 129 rows each, whatever Spark takes their size to be."""
    from kbforge.llm import simhash_segments

    plans, save = [], simhash_segments.save

    def noted(df, name):
        plans.append(df._jdf.queryExecution().sparkPlan().toString())
        return save(df, name)

    monkeypatch.setattr(simhash_segments, "save", noted)
    docs = spark.createDataFrame([(i, " ".join(f"w{i * k % 97}" for k in range(40)), "en", "a") for i in range(300)],
                                 "doc_id long, text string, lang string, source string")
    docs.write.parquet(f"{tmp_dir}/docs")
    assert stages.simhash_near_dedup(spark, spark.read.parquet(f"{tmp_dir}/docs"), tmp_dir).count() > 0
    joins = [p for p in plans if "Join" in p and "explode" in p.lower()]
    assert joins and not [p for p in joins if "BroadcastHashJoin" in p]
