import math
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from kbforge.llm import strata

SCHEMA = "doc_id long, text string"
TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, k=10):
    found = [(i, Counter(terms(t))) for i, t in docs]
    found = [(i, c, sum(c.values())) for i, c in found if c]
    count, length = len(found), sum(n for _, _, n in found)
    df = Counter(w for _, c, _ in found for w in c)
    weight = {w: math.floor(1000 * math.log((2 * count + 2) / (2 * d + 1))) for w, d in df.items()}
    out = []
    for item_id, text in items:
        scored = []
        for doc_id, c, n in found:
            m = 25 + 75 * n * count // length
            s = sum(weight[w] * ((10**9 * c[w]) // (1000 * c[w] + 8 * m)) for w in terms(text) if w in c)
            if s > 0:
                scored.append((-s, doc_id is None, doc_id or 0))
        out += [(item_id, rank, None if absent else d, -s) for rank, (s, absent, d) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def found(docs, items, **how):
    rows = strata.ranked(docs, items, **how)
    assert rows.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted((tuple(r) for r in rows.collect()), key=str)


def items_of(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


QUERIES = [(1, "The CAT sat 12345"), (2, "alpha gamma one é"), (3, ""), (4, None), (5, "absent words only"), (None, "moon cat cat cat"),
           (2**60 + 1, "another text"), (5, "beta")]


def test_edge_rows(spark, edge_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in edge_docs.collect()]
    items = items_of(spark, QUERIES)
    got = found(edge_docs, items)
    assert got == brute(rows, QUERIES) and any(r[0] == 2**60 + 1 for r in got)
    assert found(no_docs, items) == []
    assert found(edge_docs, items_of(spark, [])) == []
    assert found(edge_docs.where("text is null or doc_id = 5"), items) == []      # no document has a term


def test_equal_scores_go_by_id_and_a_hot_length(spark):
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(rng.choice(["red", "green", "blue", "x1", "été", "Z"], 6))) for i in range(400)]     # one stratum
    rows += [(400 + i, " ".join(rng.choice(list("abcdefgh"), rng.integers(1, 300)))) for i in range(300)]
    rows += rows[:30] + [(None, t) for _, t in rows[:5]]
    queries = [(i, " ".join(rng.choice(["red", "green", "x1", "été", "a", "h", "z", "none"], 4))) for i in range(12)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(9)
    assert found(docs, items_of(spark, queries)) == brute(rows, queries)
    assert found(docs, items_of(spark, queries), k=1) == brute(rows, queries, k=1)


def test_parts_and_blocks_do_not_change_results(spark, monkeypatch, tmp_dir):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = brute(rows, [(r.item_id, r.text) for r in items.collect()])
    assert found(docs, items) == want
    monkeypatch.setattr(strata, "PART_POSTINGS", 200)
    strata.build_index(docs, f"{tmp_dir}/index")
    index = spark.read.parquet(f"{tmp_dir}/index/strata")
    assert sum(len(r.doc_id) for r in index.collect()) == len([1 for _, t in rows if terms(t)])
    again = strata.search(spark, f"{tmp_dir}/index", items, block_terms=100).collect()
    assert sorted((tuple(r) for r in again), key=str) == want


def test_bound_of_a_stratum_holds(spark, tmp_dir):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    items = [(r.item_id, strata.terms(r.text)) for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()]
    strata.build_index(docs, f"{tmp_dir}/index")
    rows = spark.read.parquet(f"{tmp_dir}/index/strata").toArrow()
    block = strata.Block(items)
    block.weights[:] = np.random.default_rng(1).integers(0, 5000, len(block.weights))
    for i in range(rows.num_rows):
        s = strata._Stratum({n: rows[n][i] for n in rows.column_names}, block.hashes)
        for item, bound in enumerate(block.bounds(s)):
            assert s.scores(block.numbers[item], block.repeats[item], block.weights).max(initial=0) <= bound


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_against_sql(spark, sf):
    docs, items = (spark.read.parquet(f"/root/testdata/{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS FROM '/root/testdata/{sf}/{t}.parquet'")
    assert found(docs, items) == sorted(con.sql(strata.RANKED_SQL).fetchall(), key=str)
