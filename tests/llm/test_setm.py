import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import xxhash
from pyspark.sql import functions as F

from kbforge.llm import setm

SCHEMA = "doc_id long, text string, lang string"


def brute(rows, min_count=10, max_words=3, top=2000):
    """All phrases counted by language, the rules applied as they are told."""
    counts, sizes = {}, Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        f = counts.setdefault(lang, Counter())
        for piece in re.split("[.,;:!?\x0a-\x0d]", text):
            w = re.findall("[^\x20\x09]+", piece)
            sizes[lang] += len(w)
            f.update(tuple(w[i:i + k]) for k in range(1, max_words + 1) for i in range(len(w) - k + 1))
    out = []
    for lang, f in counts.items():
        frequent = {p: a for p, a in f.items() if len(p) > 1 and a >= min_count}
        covered = set()
        for p, a in frequent.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    if 100 * a >= 50 * f[p[i:i + k]]:
                        covered.add(p[i:i + k])
        kept = []
        for p, a in frequent.items():
            if p not in covered:
                score, _, l, r = min((10**6 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]])
                                     for k in range(1, len(p)))
                kept.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, sizes[lang], -score))
    return sorted(out)


def mined(df, **how):
    rows = setm.collocations(df, **how)
    assert rows.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(tuple(r) for r in rows.collect())


def sql(docs):
    documents = docs.select("doc_id", "text", "lang").toPandas()  # noqa: F841  read by DuckDB
    con = duckdb.connect()
    con.register("documents", documents.assign(doc_id=documents["doc_id"].astype("Int64")))
    return sorted(con.sql(setm.PHRASES_SQL).fetchall())


def test_edge_rows(edge_docs, no_docs):
    rows = [(r.text, r.lang) for r in edge_docs.collect()]
    got = mined(edge_docs)
    assert got == brute(rows) == sql(edge_docs) and got
    assert mined(no_docs) == []
    assert mined(edge_docs.where("doc_id = 10")) == []          # nothing frequent


TEXTS = [("red Red RED red red red red red red red red red red", "en"),             # overlaps count
         ("new york city. new york city, New York!new york\rnew york\x0bcity" * 3, None),
         ("a\tb  c\xa0d a\tb  c\xa0d " * 12, "und"),               # joins the null language; NBSP is no space
         ("x y\x1cz x y\x1cz " * 11, ""), ("ÉA éa ÉA b ÉA b " * 11, "fr"), (None, "fr"), ("", None), (" \t\n", "en"),
         ("\U0001f600 z \U0001f600 z " * 10 + "� z " * 25, "fr")]


@pytest.mark.parametrize("max_words", [2, 3, 4])
def test_words_pieces_and_lengths(spark, max_words):
    df = spark.createDataFrame([(i, t, g) for i, (t, g) in enumerate(TEXTS)], SCHEMA).repartition(3)
    assert mined(df, max_words=max_words) == brute(TEXTS, max_words=max_words)
    assert mined(df, max_words=max_words, top=1, min_count=3) == brute(TEXTS, 3, max_words, top=1)


def test_small_segments_many_buckets_and_a_hot_word(spark, monkeypatch):
    rows = [("the hot line of all documents is here", "en")] * 300 + [
        (" ".join(f"w{(i * 7 + j * j) % 23}" for j in range(60)), "en" if i % 3 else None) for i in range(200)]
    df = spark.createDataFrame([(i, t, g) for i, (t, g) in enumerate(rows)], SCHEMA).repartition(7)
    whole = mined(df)
    assert whole == brute(rows)
    monkeypatch.setattr(setm, "SEGMENT_WORDS", 100)
    monkeypatch.setattr(setm, "bucket_count", lambda df, keys: 37)
    assert mined(df) == whole


def test_documents_of_the_test_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").withColumn("phrase", F.lit("x"))
    assert mined(docs) == sql(docs)


def test_long_rows_are_written_in_small_row_groups(spark, monkeypatch):
    """A reader takes a row group at once, and the writer would look at its size after 100 rows only."""
    monkeypatch.setattr(setm, "SEGMENT_WORDS", 50_000)
    rng = np.random.default_rng(4)
    texts = [" ".join(map(str, rng.integers(0, 10**12, 50_000).tolist())) for _ in range(24)]
    docs = spark.createDataFrame([(t, "en") for t in texts], "text string, lang string").coalesce(1)
    found = setm.segments(docs)
    groups, rows = [], 0
    for file in found.inputFiles():
        meta = pq.ParquetFile(file.removeprefix("file:")).metadata
        rows += meta.num_rows
        groups += [meta.row_group(i).total_byte_size for i in range(meta.num_row_groups)]
    assert rows == 24 and sum(groups) > 20_000_000
    assert max(groups) < 15_000_000


def test_each_segment_of_a_batch_deals_its_own_words(spark):
    rows = [(s, lang, 0, [f"w{s}".encode(), "é".encode()] if s else [], [s, 7] if s else [], []) for s, lang in
            [(0, "en"), (1, "en"), (2, "de"), (3, "und")]]
    batch = pa.RecordBatch.from_pylist([dict(zip(("seg", "lang", "n", "words", "counts", "codes"), r)) for r in rows],
                                       schema=setm.schema_of(setm.SEGMENT)).slice(1)
    dealt = [r for b in setm._deal_words(3)(iter([batch])) for r in b.to_pylist()]
    got = {(r["seg"], at): (a, b, c) for r in dealt for at, a, b, c in zip(r["at"], r["a"], r["b"], r["c"])}
    want = {}
    for s, lang, _, words, counts, _ in rows[1:]:
        for at, (w, c) in enumerate(zip(words, counts)):
            a, b = np.frombuffer(xxhash.xxh3_128_digest(lang.encode() + b"\x00" + w), "<i8").tolist()
            want[s, at] = (a, b, c)
    assert got == want
