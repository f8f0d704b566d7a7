import re

import numpy as np
import pytest
import xxhash

from kbforge.llm import simhash_segments as S
from kbforge.llm.components import connected_components


def brute_print(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall("[^\x20\x09-\x0D]+", text)
    if not w:
        return 0
    s = [" ".join(w)] if len(w) < 3 else [" ".join(w[i:i + 3]) for i in range(len(w) - 2)]
    h = [xxhash.xxh64(x.encode(), seed=42).intdigest() for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in h) > len(h))


def brute_classes(values, limit=2):
    """Smallest reachable value of each one."""
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    values = sorted(set(values))
    for i, a in enumerate(values):
        for b in values[i + 1:]:
            if ((a ^ b) & (2**64 - 1)).bit_count() <= limit and find(a) != find(b):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {v: find(v) for v in values}


@pytest.mark.parametrize("text", ["", "  ", "One", "One TWO", "a b c", "É a B c d a b c", "x\xa0y z\tw\x0bq", "na " * 2000,
                                  "".join(f"w{i} " for i in range(5000))])
def test_fingerprint(text):
    assert S.fingerprint(text) % 2**64 == brute_print(text)


def clustered(seed=0):
    rng = np.random.default_rng(seed)
    out = [int(v) for v in rng.integers(-2**63, 2**63, 60)]
    for centre in out[:6]:                           # chains and crowds of near fingerprints
        v = centre
        for _ in range(25):
            v ^= 1 << int(rng.integers(0, 63))
            out.append(v)
        for _ in range(25):
            out.append(centre ^ (1 << int(rng.integers(0, 63))) ^ (1 << int(rng.integers(0, 63))))
    return out + [0, -1, 1, -2**63]


@pytest.mark.parametrize("segments,cell_rows", [(16, 48), (16, 2), (8, 4), (32, 48)])
def test_links_connect_exactly_what_brute_force_does(spark, segments, cell_rows):
    values = sorted(set(clustered()))
    nodes = spark.createDataFrame([(v,) for v in values], "fp long")
    links = S.links(nodes, segments, cell_rows)
    pairs = [(r.u, r.v) for r in links.collect()]
    assert all(0 < ((u ^ v) & (2**64 - 1)).bit_count() <= 2 for u, v in pairs)
    got = {r.node: r.root for r in connected_components(links).collect()}
    want = {v: r for v, r in brute_classes(values).items()}
    groups = lambda m: {frozenset(k for k in values if m.get(k, k) == r) for r in {m.get(k, k) for k in values}}
    assert groups(got) == groups(want)


def test_components_of_a_long_chain_a_star_and_loops(spark):
    rows = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 300)] + [(5000, 5000)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(rows, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(201)}, **{i: 1000 for i in range(1000, 1300)}}
    assert connected_components(spark.createDataFrame([], "u long, v long")).collect() == []


def test_documents_with_edge_rows(edge_docs, no_docs):
    got = S.near_duplicates(edge_docs).collect()
    rows = edge_docs.collect()
    assert sorted((str(r.doc_id), r.fp % 2**64) for r in got) == sorted((str(r.doc_id), brute_print(r.text)) for r in rows)
    lowest = {}
    for r in got:
        lowest.setdefault(r.fp, []).append(r.doc_id)
    for r in got:
        ids = [i for i in lowest[r.fp] if i is not None]
        assert r.component_id == (min(ids) if ids else None)
    assert S.near_duplicates(no_docs).collect() == []
    assert len(S.near_duplicates(edge_docs, max_bits=0).collect()) == len(rows)


@pytest.fixture()
def written_plans(monkeypatch):
    """Plan of every table that the operator writes, by name."""
    plans, save = {}, S.save

    def noted(df, name):
        plans[name] = df._jdf.queryExecution().sparkPlan().toString()
        return save(df, name)

    monkeypatch.setattr(S, "save", noted)
    return plans


def test_exploded_rows_are_never_broadcast(spark, tmp_dir, written_plans):
    """A small table of fingerprints has 33 and 129 cells each, which Spark sizes as the fingerprints alone."""
    spark.createDataFrame([(v,) for v in sorted(set(clustered()))], "fp long").write.parquet(f"{tmp_dir}/fp")
    links = S.links(spark.read.parquet(f"{tmp_dir}/fp"), cell_rows=2)
    plans = [written_plans["cells"], links._jdf.queryExecution().sparkPlan().toString()]
    assert all("SortMergeJoin" in p and "BroadcastHashJoin" not in p for p in plans)
