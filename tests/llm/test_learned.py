"""Trained operators: exact parts against brute force, the rest by held-out accuracy."""
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from kbforge.llm import bytecnn as L
from kbforge.llm import docstats as D
from kbforge.llm import fm_toxicity as X
from kbforge.llm import gbt_quality as Q
from kbforge.llm import rulefit as R
from kbforge.llm.trees import Bins, boost, grow

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


def accuracy(rows, labels, label, held):
    truth = {r["doc_id"]: r[label] for r in labels.collect()}
    hits = [(r["predicted"], truth[r["doc_id"]]) for r in rows if r["doc_id"] in truth and r["held_out"] == held]
    return hits


# ---- statistics
def brute_repeat_words(words):
    windows = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    count, hit = Counter(windows), set()
    for i, w in enumerate(windows):
        if count[w] > 1:
            hit |= set(range(i, i + 8))
    return len(hit)


@pytest.mark.parametrize("seed", range(30))
def test_counts(seed):
    rng = random.Random(seed)
    text = "".join(rng.choice(["a", "b", "Aé", " ", " ", "\n", "\n", "#", "|", "中", "\t", "\xa0", "x y z a b c d e f\n"])
                   for _ in range(rng.randint(0, 150)))
    words = [w for w in __import__("re").split("[\x20\x09-\x0D]+", text) if w]
    lines = [x for x in text.split("\n") if x.strip("\x20\x09\x0a\x0b\x0c\x0d")]
    got = dict(zip(D.ALL, D.measure(text), strict=True))
    assert got["n_words"] == len(words) and got["word_chars"] == sum(map(len, words))
    assert got["n_symbols"] == sum(c in "#*$%&|<>" for c in text)
    assert got["n_dup_lines"] == len(lines) - len(set(lines))
    assert got["n_repeat_words"] == brute_repeat_words(words)
    assert all(np.isfinite(v) for v in got.values())


# ---- trees
def test_tree_scores_as_its_nodes_say():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 5))
    t = grow(Bins(x), rng.normal(size=400), np.ones(400), 4, 5)
    for row, got in zip(x[:100], t.score(x[:100]), strict=True):
        n = 0
        while t.left[n] != n:
            n = t.left[n] if row[t.feature[n]] <= t.threshold[n] else t.right[n]
        assert t.value[n] == got


@pytest.mark.parametrize("sign", [1, -1])
def test_monotonic_constraint_holds_everywhere(sign):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(1500, 4))
    y = (np.sin(3 * x[:, 0]) + x[:, 1] + 0.3 * rng.normal(size=1500) > 0).astype(float)     # not monotonic in 0
    model = boost(x, y, 40, 3, monotone={0: sign})
    probe = np.repeat(rng.normal(size=(60, 4)), 41, axis=0)
    probe[:, 0] = np.tile(np.linspace(-3, 3, 41), 60)
    score = model.score(probe).reshape(60, 41)
    assert (sign * np.diff(score, axis=1) >= -1e-12).all()


# ---- operator 4
def test_quality_trees(tables):
    docs, labels = tables
    model = Q.train(docs, labels)
    rows = Q.verdicts(docs, model).collect()
    truth = {r.doc_id: r.quality for r in labels.collect()}
    held = [r for r in rows if r.doc_id in truth and zlib.crc32(str(r.doc_id).encode()) % 5 == 0 and not r.base_failed]
    assert np.mean([r.kept == bool(truth[r.doc_id]) for r in held]) > 0.97
    assert len(rows) == docs.count()


def test_quality_trees_edge_rows(edge_docs, no_docs, no_labels):
    assert Q.train(edge_docs, no_labels) is None
    got = Q.verdicts(edge_docs, None).collect()
    assert len(got) == edge_docs.count()
    assert all(r.kept == (not r.base_failed) for r in got)
    assert {r.doc_id: (r.n_words, r.base_failed) for r in got if r.doc_id in (3, 4, 5, 6)} == {
        3: (0, True), 4: (0, True), 5: (0, True), 6: (60_000, True)}
    assert Q.verdicts(no_docs, None).collect() == []


# ---- operator 9
def test_rules_as_columns_score_like_numpy(tables):
    docs, labels = tables
    x, y = Q.training_table(docs, labels, "quality", 2000)
    model = R.fit(x, y)
    assert 0 < len(model.rules) < 60
    rows = Q.statistics(docs.limit(500)).select("*", R.score_column(model, F.col).alias("score")).collect()
    table = np.array([[r[c] for c in D.RATIOS] for r in rows])
    want = R.sigmoid(model.intercept + R.holds(model.rules, table) @ np.array(model.weights))
    assert np.allclose([r.score for r in rows], want, atol=1e-12)


def test_lasso_is_at_a_minimum():
    rng = np.random.default_rng(3)
    a = (rng.random((500, 12)) < 0.4).astype(float)
    y = (a[:, 0] + a[:, 1] - a[:, 2] + 0.5 * rng.normal(size=500) > 0.5).astype(float)
    b, w = R.lasso_logistic(a, y, 0.02, 3000)
    loss = lambda b, w: np.mean(np.logaddexp(0, b + a @ w) - y * (b + a @ w)) + 0.02 * np.abs(w).sum()
    best = loss(b, w)
    for _ in range(200):
        assert best <= loss(b + 0.01 * rng.normal(), w + 0.01 * rng.normal(size=12)) + 1e-9
    assert (w == 0).sum() >= 3


def test_rule_ensemble_held_out(tables):
    docs, labels = tables
    rows = R.scores(docs, R.train(docs, labels)).collect()
    hits = accuracy(rows, labels, "quality", True)
    assert len(hits) > 500 and np.mean([p == t for p, t in hits]) > 0.97
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)


def test_rule_ensemble_edge_rows(edge_docs, no_docs, no_labels, tables):
    assert [(r.score, r.predicted) for r in R.scores(edge_docs, R.train(edge_docs, no_labels)).collect()] == [(0.5, 1)] * 11
    model = R.train(*tables, max_rows=1500)
    assert all(0 <= r.score <= 1 for r in R.scores(edge_docs, model).collect())
    assert R.scores(no_docs, model).collect() == []
    kept = R.keep_good(edge_docs, model)
    assert kept.columns == edge_docs.columns and kept.count() == sum(r.predicted for r in R.scores(edge_docs, model).collect())


# ---- operator 6
def test_pairs_matter_to_the_machine():
    """Neither word alone is toxic, both together are: only the factors can tell."""
    rng = random.Random(5)
    docs, y = [], []
    for _ in range(3000):
        words = {f"filler{rng.randrange(40)}" for _ in range(4)}
        a, b = rng.random() < 0.5, rng.random() < 0.5
        words |= ({"rude"} if a else {"nice"}) | ({"folk"} if b else {"tree"})
        docs.append(np.array([X.terms(w) for w in sorted(words)]))
        y.append(float(a == b))                      # a linear model scores every document alike
    model = X.fit(docs[:2500], np.array(y[:2500]))
    z = []
    for d in docs[2500:]:
        idx = np.array([[model.term.get(int(t), 0) for t in row] for row in d])
        f = model.factors[idx].sum(axis=1)
        z.append(model.bias + model.linear[idx].sum() + ((f.sum(axis=0) ** 2).sum() - (f ** 2).sum()) / (2 * len(d)))
    assert np.mean((np.array(z) > 0) == np.array(y[2500:])) > 0.95


def pair_sums(model, docs):
    out = []
    for d in docs:
        idx = np.array([[model.term.get(int(t), 0) for t in row] for row in d] or [[0] * X.TERMS])
        f = model.factors[idx].sum(axis=1)
        out.append((model.bias + model.linear[idx].sum(), ((f.sum(axis=0) ** 2).sum() - (f ** 2).sum()) / (2 * max(1, len(d)))))
    return np.array(out)


def test_pairs_take_part_on_the_tables(tables):
    """The shipped machine has factors, and the pair sum moves scores and decisions of real rows."""
    docs, labels = tables
    model = X.train(docs, labels)
    assert 100 < model.factors.any(axis=1).sum() < len(model.linear) <= 20_000
    texts = [r.text for r in docs.join(labels, "doc_id").select("text").collect()]
    z = pair_sums(model, [[X.terms(w) for w in sorted(X.words_of(t or ""))] for t in texts])
    linear, pairs = z[:, 0], z[:, 1]
    assert (np.abs(pairs) > 0.1).mean() > 0.5 and ((linear >= 0) != (linear + pairs >= 0)).sum() >= 1


def test_repeated_ids_do_not_pass_the_bound_of_training_rows(spark, monkeypatch):
    rows = [(1, f"text number {i} of one id", "en") for i in range(3000)] + [(i, f"good words {i}", "en") for i in range(2, 200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(1, 200)], "doc_id long, quality int, toxic int")
    x, y = Q.training_table(docs, labels, "quality", 50)
    assert len(x) == len(y) <= 50
    seen = []
    monkeypatch.setattr(X, "fit", lambda rows, y: seen.append(len(rows)))
    X.train(docs, labels, max_rows=60)
    assert 30 < seen[0] <= 60
    monkeypatch.setattr(L, "fit", lambda x, y, languages: seen.append(len(x)))
    L.train(docs, max_rows=40)
    assert 30 < seen[1] <= 3 * 41


def test_all_languages_are_learned(spark):
    names = [f"l{k:03d}" for k in range(230)]
    rows = [(7 * k + j, f"abc {chr(0x400 + k)} {chr(0x400 + k) * 5} text", n) for k, n in enumerate(names) for j in range(6)]
    net = L.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), max_rows=300)
    assert net.languages == names


def test_bounded_word_rows_do_not_change_scores(tables):
    docs, labels = tables
    model = X.train(docs, labels, max_rows=1500)
    texts = [r.text for r in docs.select("text").limit(60).collect()]
    big, small = X.Scorer(model), X.Scorer(model, max_words=50)
    assert [big.score(t) for t in texts] == pytest.approx([small.score(t) for t in texts], abs=1e-12)


def test_toxicity_held_out(tables):
    docs, labels = tables
    rows = X.scores(docs, X.train(docs, labels)).collect()
    hits = accuracy(rows, labels, "toxic", True)
    found = [p for p, t in hits if t]
    assert np.mean(found) > 0.8 and np.mean([p for p, t in hits if not t]) < 0.01


def test_toxicity_edge_rows(edge_docs, no_docs, no_labels, tables):
    assert {r.score for r in X.scores(edge_docs, X.train(edge_docs, no_labels)).collect()} == {0.0}
    model = X.train(*tables, max_rows=800)
    got = X.scores(edge_docs, model).collect()
    assert len(got) == 11 and all(0 <= r.score <= 1 for r in got)
    assert X.scores(no_docs, model).collect() == []


# ---- operator 8
def test_language_held_out(tables):
    docs, _ = tables
    net = L.train(docs, max_rows=2000)
    rows = L.predictions(docs, net).collect()
    lang = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    held = [r for r in rows if r.held_out]
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in held]) > 0.98
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)


def test_pair_tables_score_like_the_plain_network(tables):
    docs, _ = tables
    net = L.train(docs, max_rows=300)
    x = np.concatenate([L.windows(r.text)[0] for r in docs.select("text").limit(20).collect()])
    pooled = []
    for width, t, offset in zip(L.WIDTHS, net.tables, net.offsets, strict=True):
        places = L.WINDOW - width + 1
        total = sum(t[j][x[:, j:j + places]] for j in range(width))
        pooled.append(np.maximum(total.max(axis=1) + offset, 0))
    want = L.softmax(np.concatenate(pooled, axis=1) @ net.dense + net.bias)
    assert np.allclose(net.probabilities(x, net.pairs(), rows=7), want, atol=1e-4)


def test_language_edge_rows(edge_docs, no_docs, tables):
    net = L.train(tables[0], max_rows=300)
    got = {(r.doc_id, r.lang_pred == "und", r.score == 0) for r in L.predictions(edge_docs, net).collect()}
    assert {(d, u) for d, u, _ in got} == {(7, False), (None, False), (None, True), (3, True), (4, True), (5, True),
                                           (6, False), (9, True), (10, False)}
    assert all(u == z for _, u, z in got)
    assert L.train(no_docs) is None and L.predictions(no_docs, net).collect() == []
    assert {r.lang_pred for r in L.predictions(edge_docs, None).collect()} == {"und"}
