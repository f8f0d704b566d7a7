import re
from itertools import combinations as pairs_of

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from kbforge.llm import combinations as C
from tests.llm.conftest import by_id

SCHEMA = "doc_id long, text string"


def shingles(text):
    w = re.findall("[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return frozenset()
    return frozenset([tuple(w)] if len(w) < 4 else [tuple(w[i:i + 4]) for i in range(len(w) - 3)])


def brute(rows, percent=85):
    """(doc_id, n_shingles, component_id) by comparing all pairs of different sets."""
    sets = [shingles(t) for _, t in rows]
    distinct = [s for s in set(sets) if s]
    root = {s: s for s in distinct}

    def find(s):
        while root[s] != s:
            s = root[s]
        return s

    for a, b in pairs_of(distinct, 2):
        if 100 * len(a & b) >= percent * len(a | b):
            root[find(a)] = find(b)
    low = {}
    for (doc_id, _), s in zip(rows, sets, strict=True):
        if s and doc_id is not None:
            low[find(s)] = min(low.get(find(s), doc_id), doc_id)
    return [(d, len(s), low.get(find(s)) if s else d) for (d, _), s in zip(rows, sets, strict=True)]


def joined(df, **how):
    out = C.similar_documents(df, **how)
    assert out.columns == ["doc_id", "n_shingles", "component_id"]
    return sorted((tuple(r) for r in out.collect()), key=str)


def check(spark, rows, **how):
    got = joined(spark.createDataFrame(rows, SCHEMA).repartition(5), **how)
    assert got == sorted(brute(rows), key=str)
    return got


def edited(rng, words, edits):
    w = list(words)
    for _ in range(edits):
        w[rng.integers(len(w))] = f"e{rng.integers(10**9)}"
    return " ".join(w)


def test_edge_rows(edge_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in edge_docs.collect()]
    assert joined(edge_docs) == sorted(brute(rows), key=str)
    assert joined(no_docs) == []
    assert by_id(C.similar_documents(edge_docs.where("doc_id in (3, 4, 5)")).collect()) == [
        (3, 0, 3), (4, 0, 4), (5, 0, 5)]                    # no words: linked with nothing


def test_short_documents_around_the_threshold(spark):
    w = [f"w{i}" for i in range(40)]
    rows = [(i, " ".join(w[:n])) for i, n in enumerate(range(1, 40))]            # 6 of 7, 17 of 20, ...
    rows += [(100 + i, " ".join(w[i:i + 9])) for i in range(8)] + [(200, "W0 w1"), (201, "w0  W1"), (None, "w0 w1"), (None, "zz")]
    check(spark, rows)


@pytest.mark.parametrize("hot", [32, 3])
def test_groups_of_near_copies(spark, hot):
    rng = np.random.default_rng(7)
    rows, at = [], 0
    for size, length in ((2, 60), (40, 50), (120, 90), (5, 400), (60, 12), (30, 5)):
        base = [f"b{rng.integers(10**9)}" for _ in range(length)]
        for _ in range(size):
            rows.append((at, edited(rng, base, rng.integers(0, max(2, length // 16)))))
            at += 1
    common = "this passage stands in very many of the documents and so its words are frequent all over".split()
    rows += [(at + i, " ".join(common + [f"u{rng.integers(10**9)}" for _ in range(rng.integers(0, 9))])) for i in range(150)]
    rows += [(5000 + i, t) for i, (_, t) in enumerate(rows[::7])] + [(None, t) for _, t in rows[:40:13]]
    got = check(spark, rows, hot=hot)
    assert 10 < len({c for _, _, c in got}) < len(got)


def test_small_classes_use_combinations(spark, monkeypatch):
    """Pairs and triples for everything but the rarest tokens, small blocks, many links found late."""
    rng = np.random.default_rng(11)
    rows = []
    for g in range(6):
        base = [f"b{g}x{i}" for i in range(70)]
        rows += [(100 * g + i, edited(rng, base, rng.integers(0, 5))) for i in range(60)]
    for name, value in (("CLASS_DF", (2, 12)), ("BLOCK", 7), ("HOT_SHARE", 20)):
        monkeypatch.setattr(C, name, value)
    # parameters of functions are bound when they are defined
    plain = C.signatures
    monkeypatch.setattr(C, "signatures", lambda n, token, df, percent: plain(n, token, df, percent, (2, 12)))
    check(spark, rows, hot=4)


@settings(max_examples=200, deadline=None)
@given(st.data())
def test_linked_sets_share_a_combination(data):
    """The prefix rule: whatever the frequencies, two linked sets have a signature in common."""
    n = data.draw(st.integers(1, 150))
    rng = np.random.default_rng(data.draw(st.integers(0, 10**6)))
    universe = rng.permutation(2 * n + 8) + 1
    df = dict(zip(universe.tolist(), rng.choice([2, 3, 20, 40, 500, 1500, 9000], len(universe)), strict=True))
    x = universe[:n]
    drop, extra = rng.integers(0, max(1, n // 8) + 1), rng.integers(0, max(1, n // 8) + 1)
    y = np.concatenate([x[drop:], universe[n:n + extra]])
    shared = len(np.intersect1d(x, y))
    if not shared or 100 * shared < 85 * (len(x) + len(y) - shared):
        return
    sig = []
    for s in (x, y):
        s = np.array(sorted(s.tolist(), key=lambda t: (df[t], t)), np.int64)
        sig.append(C.signatures(len(s), s, np.array([df[t] for t in s.tolist()])))
    assert len(np.intersect1d(*sig))


def test_overlaps_in_parts_of_the_vocabulary():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 300, rng.integers(1, 80))) for _ in range(20)]
    ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    got = C._overlaps(np.concatenate(sets), ends, np.arange(8), np.arange(8, 20), width=17)
    assert got.tolist() == [[len(np.intersect1d(a, b)) for b in sets[8:]] for a in sets[:8]]
