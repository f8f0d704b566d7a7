"""Ranked lexical search over a length-stratified index (operator 12).

The score of a document depends on its length only through the normaliser m, so
documents of equal m form a stratum.  The index holds, per stratum, its terms, and
per term its postings in runs of equal tf: one impact, ``(10**9 * tf) div (1000 * tf +
8 * m)``, serves a whole run and is computed once per tf.  A term's last run has
its largest tf in the stratum, so the sum of the last runs' impacts over an item's
terms bounds the score of every document there.

A search makes two rounds over the strata.  In the first each task visits, for
every item, the stratum it has with the best bound; the k-th best score found over
all tasks is the item's first threshold.  In the second each task takes its strata
by falling bound and visits those whose bound reaches the threshold, which its own
findings raise.  Every stratum is indexed and none is left out that could hold a
result.

The documents are dealt to buckets of about equal numbers of terms: ranges of strata,
and shares of a stratum that is larger, so one with a third of all documents is
spread over many tasks.  A stratum of more than ``PART_POSTINGS`` postings has several
rows.  The items are a query set, read in
blocks of at most ``block_terms`` terms.  Terms meet by a 64-bit hash.

Null text has no terms; such documents are not counted and never found.  Documents
with a null doc_id are found like others, after those with one among equal scores.
Repeated documents take a rank each; repeated items give repeated rows.  Items
without terms have no rows.  Empty tables give empty results.  Other columns are not
read.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kbforge.llm.common import prepare, save, scratch
from kbforge.llm.packed import flat, lists, offsets, runs, schema_of

PART_POSTINGS = 500_000
BLOCK_TERMS = 100_000
# ASCII letters in lower case, digits and all bytes of other characters; the rest parts terms
_LOWER = bytes(c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in bytes(range(256)).lower())

STRATUM = ("m long, doc_id array<long>, term array<long>, term_runs array<int>, run_tf array<int>, "
           "run_docs array<int>, doc array<int>")
DEALT = "bucket int, m long, h long, doc_id long, term array<long>, tf array<int>"
FOUND = "item_no int, item_id long, doc_id long, score long"


def terms(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_LOWER).split()


class _Hashes(dict):
    """Signed 64-bit hashes of terms, remembered."""

    def __missing__(self, term: bytes) -> int:
        import xxhash

        if len(self) >= 300_000:
            self.clear()
        h = xxhash.xxh64_intdigest(term)
        self[term] = h = h - (1 << 64) if h >> 63 else h
        return h


def normaliser(n: int, documents: int, all_terms: int) -> int:
    """m of a document of ``n`` terms."""
    return 25 + (75 * n * documents) // max(all_terms, 1)


def _lengths(rows: DataFrame) -> DataFrame:
    """(n, documents): how many documents have ``n`` terms, n above 0."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, count = np.unique([len(terms(t.as_py())) for t in batch.column(0)], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(n, pa.int64()), pa.array(count, pa.int64())], names=["n", "documents"])

    counted = rows.select("text").mapInArrow(run, "n long, documents long")
    return counted.where("n > 0").groupBy("n").agg(F.sum("documents").alias("documents"))


def _bin(m: int) -> int:
    """Strata in order, the long ones some together, so that their number is bounded."""
    return m if m < 4096 else 4096 + int(256 * math.log2(m / 4096))


class _Dealer:
    """Buckets of about ``target`` terms: ranges of strata, or shares of one stratum (by a hash)."""

    def __init__(self, sizes: list[tuple[int, int]], target: int):
        self.first, self.shares, bucket, held = [], [], 0, target
        self.start = []
        for b, words in sorted(sizes):
            if words > target or held + words > target:
                self.first.append(b)
                self.shares.append(max(1, -(-words // target)))
                self.start.append(bucket)
                bucket += self.shares[-1]
                held = words if words <= target else target
            else:
                held += words
        self.buckets = max(1, bucket)

    def bucket(self, m: int, h: int) -> int:
        k = bisect_right(self.first, _bin(m)) - 1
        return self.start[k] + h % self.shares[k]


def build_index(docs: DataFrame, path: str) -> None:
    """Write ``<path>/strata`` and ``<path>/totals`` (documents, terms) for all documents."""
    spark = prepare(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null")
    lengths = save(_lengths(rows), "lengths")
    lengths.agg(F.coalesce(F.sum("documents"), F.lit(0)).alias("documents"),
                F.coalesce(F.sum(F.col("n") * F.col("documents")), F.lit(0)).alias("terms")).write.parquet(f"{path}/totals")
    count, length = spark.read.parquet(f"{path}/totals").first()

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, d = (batch.column(k).to_pylist() for k in (0, 1))
            yield pa.RecordBatch.from_arrays([
                pa.array([_bin(normaliser(x, count, length)) for x in n], pa.int64()),
                pa.array([x * y for x, y in zip(n, d, strict=True)], pa.int64())], names=["b", "terms"])

    # a few thousand bins at most
    sizes = lengths.mapInArrow(binned, "b long, terms long").groupBy("b").agg(F.sum("terms").alias("terms")).collect()
    cores = spark.sparkContext.defaultParallelism
    dealer = _Dealer([(r["b"], r["terms"]) for r in sizes], min(2 * PART_POSTINGS, max(1, length // (2 * cores))))
    dealt_to = schema_of(DEALT)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        known = _Hashes()
        for batch in batches:
            out: dict[str, list] = {f.name: [] for f in dealt_to}
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py()
                found = terms(text)
                if not found:
                    continue
                m = normaliser(len(found), count, length)
                h = xxhash.xxh64_intdigest(f"{doc_id}:{len(text)}:{text[:64]}".encode("utf-8", "surrogatepass")) >> 1
                counts = Counter(map(known.__getitem__, found))
                for name, v in zip(out, (dealer.bucket(m, h), m, h, doc_id, np.fromiter(counts.keys(), np.int64, len(counts)),
                                         np.fromiter(counts.values(), np.int32, len(counts))), strict=True):
                    out[name].append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in dealt_to], schema=dealt_to)

    target = schema_of(STRATUM)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = _Part()
        for batch in batches:
            (term, ends), (tf, _) = flat(batch.column("term")), flat(batch.column("tf"))
            for i, (m, doc_id) in enumerate(zip(batch.column("m").to_pylist(), batch.column("doc_id").to_pylist(), strict=True)):
                if part.m != m or part.size >= PART_POSTINGS:
                    yield from part.rows(target)
                    part = _Part(m)
                part.add(doc_id, term[ends[i]:ends[i + 1]], tf[ends[i]:ends[i + 1]])
        yield from part.rows(target)

    (rows.mapInArrow(deal, DEALT).repartition(dealer.buckets, "bucket").sortWithinPartitions("m", "h")
     .mapInArrow(build, STRATUM).write.parquet(f"{path}/strata"))


class _Part:
    """Documents of one stratum while they are read."""

    def __init__(self, m: int | None = None):
        self.m, self.size, self.ids, self.term, self.tf = m, 0, [], [], []

    def add(self, doc_id: int | None, term: np.ndarray, tf: np.ndarray) -> None:
        self.ids.append(doc_id)
        self.term.append(term)
        self.tf.append(tf)
        self.size += len(term)

    def rows(self, target: pa.Schema) -> Iterator[pa.RecordBatch]:
        if not self.ids:
            return
        term, tf = np.concatenate(self.term), np.concatenate(self.tf)
        doc = np.repeat(np.arange(len(self.ids)), [len(t) for t in self.term])
        order = np.lexsort((doc, tf, term))
        term, tf, doc = term[order], tf[order], doc[order]
        run, own = runs(term, tf), runs(term)
        one = lambda v, name: lists(v, offsets(np.array([len(v)])), target.field(name).type)
        yield pa.RecordBatch.from_arrays([
            pa.array([self.m], pa.int64()), pa.array([self.ids], target.field("doc_id").type), one(term[own], "term"),
            one(np.append(np.searchsorted(run, own), len(run)), "term_runs"), one(tf[run], "run_tf"),
            one(np.append(run, len(term)), "run_docs"), one(doc, "doc")], schema=target)


class _Stratum:
    """One row of the index, with the terms of ``hashes`` looked up."""

    def __init__(self, row: dict, hashes: np.ndarray):
        self.m, self.row = row["m"].as_py(), row
        value = lambda name: np.asarray(row[name].values)
        term, self.term_runs = value("term"), value("term_runs")
        at = np.minimum(np.searchsorted(term, hashes), len(term) - 1)
        self.have = term[at] == hashes
        self.at = at
        self.run_tf, self.run_docs, self.doc = value("run_tf"), value("run_docs"), value("doc")

    def df(self) -> np.ndarray:
        first, last = self.term_runs[self.at], self.term_runs[self.at + 1]
        return np.where(self.have, self.run_docs[last] - self.run_docs[first], 0)

    def impact(self, tf: np.ndarray) -> np.ndarray:
        return (1_000_000_000 * tf.astype(np.int64)) // (1000 * tf.astype(np.int64) + 8 * self.m)

    def most(self, weights: np.ndarray) -> np.ndarray:
        """Per looked-up term the most that one occurrence in an item can add to a score."""
        return np.where(self.have, weights * self.impact(self.run_tf[self.term_runs[self.at + 1] - 1]), 0)

    def scores(self, term_numbers: np.ndarray, repeats: np.ndarray, weights: np.ndarray) -> np.ndarray:
        out = np.zeros(len(self.row["doc_id"].values), np.int64)
        for t, q in zip(term_numbers.tolist(), repeats.tolist(), strict=True):
            if self.have[t] and weights[t]:
                first, last = self.term_runs[self.at[t]], self.term_runs[self.at[t] + 1]
                impact = weights[t] * q * self.impact(self.run_tf[first:last])      # once per tf
                edge = self.run_docs[first:last + 1]
                out[self.doc[edge[0]:edge[-1]]] += np.repeat(impact, np.diff(edge))
        return out


class _Best:
    """The k best (score, doc_id) of each item met so far."""

    def __init__(self, block: Block, k: int, floor: np.ndarray):
        self.block, self.k, self.floor = block, k, floor.copy()
        self.found: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    def add(self, item: int, scores: np.ndarray, ids: pa.Array) -> None:
        good = np.flatnonzero(scores >= max(self.floor[item], 1))
        if not len(good):
            return
        doc = ids.take(pa.array(good))
        new = (scores[good], np.asarray(doc.fill_null(0)), np.asarray(doc.is_null()))
        if item in self.found:
            new = tuple(np.concatenate(p) for p in zip(self.found[item], new, strict=True))
        order = np.lexsort((new[1], new[2], -new[0]))[:self.k]
        self.found[item] = new = tuple(p[order] for p in new)
        if len(order) == self.k:
            self.floor[item] = max(self.floor[item], new[0][-1])

    def rows(self, target: pa.Schema) -> Iterator[pa.RecordBatch]:
        for item, (score, doc, absent) in self.found.items():
            n = len(score)
            yield pa.RecordBatch.from_arrays([
                pa.array([item] * n, pa.int32()), pa.array([self.block.item_ids[item]] * n, pa.int64()),
                pa.array(doc, pa.int64(), mask=absent), pa.array(score, pa.int64())], schema=target)


class Block:
    """Items of a bounded number of terms: what a search sends to the tasks."""

    def __init__(self, items: list[tuple]):
        self.item_ids = [item_id for item_id, _ in items]
        counts = [Counter(words) for _, words in items]
        vocabulary = sorted({w for c in counts for w in c})
        number = {w: i for i, w in enumerate(vocabulary)}
        known = _Hashes()
        self.hashes = np.array([known[w] for w in vocabulary], np.int64)
        self.numbers = [np.array([number[w] for w in c], np.int64) for c in counts]
        self.repeats = [np.array(list(c.values()), np.int64) for c in counts]
        self.weights = np.zeros(len(vocabulary), np.int64)

    def bounds(self, stratum: _Stratum) -> np.ndarray:
        most = stratum.most(self.weights)
        return np.array([int((most[t] * q).sum()) for t, q in zip(self.numbers, self.repeats, strict=True)], np.int64)


def blocks(items: DataFrame, block_terms: int) -> Iterator[Block]:
    """The items in blocks of about ``block_terms`` terms of four characters, or one item."""
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    total = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = -(-int(total) // (4 * block_terms))
    for part in range(parts):
        table = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part).toArrow()
        named = zip(table["item_id"].to_pylist(), table["text"].to_pylist(), strict=True)
        found = [(i, t, terms(t)) for i, t in named]
        found = sorted((x for x in found if x[2]), key=lambda x: (x[0] is None, x[0] or 0, x[1]))
        if found:
            yield Block([(i, words) for i, _, words in found])


def _weigh(strata: DataFrame, block: Block, documents: int) -> None:
    """Document frequencies of the block's terms over all strata, as weights."""
    hashes = block.hashes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(len(hashes), np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                df += _Stratum({n: batch.column(n)[i] for n in batch.schema.names}, hashes).df()
        term = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(term, pa.int32()), pa.array(df[term], pa.int64())],
                                         names=["term", "df"])

    # at most one row per term of the block
    rows = strata.mapInArrow(run, "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).collect()
    for term, df in rows:
        block.weights[term] = math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


def _round(strata: DataFrame, block: Block, k: int, floor: np.ndarray, best_only: bool) -> DataFrame:
    target = schema_of(FOUND)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Best(block, k, floor)
        for batch in batches:
            strata_ = [_Stratum({n: batch.column(n)[i] for n in batch.schema.names}, block.hashes)
                       for i in range(batch.num_rows)]
            if not strata_:
                continue
            bounds = np.array([block.bounds(s) for s in strata_])
            for item in range(len(block.item_ids)):
                order = np.argsort(-bounds[:, item], kind="stable")
                for s in order[:1 if best_only else None]:
                    if bounds[s, item] < max(best.floor[item], 1):
                        break
                    stratum = strata_[s]
                    best.add(item, stratum.scores(block.numbers[item], block.repeats[item], block.weights),
                             stratum.row["doc_id"].values)
        yield from best.rows(target)

    return strata.mapInArrow(run, FOUND)


def search(spark: SparkSession, path: str, items: DataFrame, k: int = 10, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents of each row of ``items`` (item_id, text)."""
    strata = spark.read.schema(STRATUM).parquet(f"{path}/strata")
    documents = spark.read.parquet(f"{path}/totals").first()["documents"]
    order = Window.partitionBy("item_no").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    out = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for block in blocks(items, block_terms):
        _weigh(strata, block, documents)
        floor = np.zeros(len(block.item_ids), np.int64)
        first = _round(strata, block, k, floor, best_only=True)
        kth = (first.withColumn("rank", F.row_number().over(order)).where(F.col("rank") == k)
               .select("item_no", "score").collect())           # at most one row per item of the block
        for item, score in kth:
            floor[item] = score
        found = _round(strata, block, k, floor, best_only=False)
        out = out.unionByName(found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
                              .select("item_id", "rank", "doc_id", "score"))
    return out


def ranked(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """Index all of ``docs`` in a scratch folder and search it for every item."""
    path = scratch(docs.sparkSession, "strata")
    build_index(docs, path)
    return search(docs.sparkSession, path, items, k)


RANKED_SQL = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS row_no, regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents WHERE text IS NOT NULL),
sizes AS (SELECT doc_id, row_no, len(w) AS n, w FROM d WHERE len(w) > 0),
totals AS (SELECT count(*) AS nn, sum(n)::BIGINT AS ll FROM sizes),
norm AS (SELECT doc_id, row_no, w, 25 + ((75 * n * nn) // ll) AS m FROM sizes, totals),
tfs AS (SELECT doc_id, row_no, m, term, count(*) AS tf FROM (SELECT doc_id, row_no, m, unnest(w) AS term FROM norm)
        GROUP BY ALL),
weights AS (SELECT term, floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS weight
            FROM (SELECT term, count(*) AS df FROM tfs GROUP BY term), totals),
items AS (
  SELECT item_id, item_no, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM (SELECT *, row_number() OVER () AS item_no FROM benchmark)),
scored AS (
  SELECT item_id, item_no, doc_id, row_no, sum(q * weight * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
  FROM (SELECT item_id, item_no, term, count(*) AS q FROM items GROUP BY ALL)
  JOIN weights USING (term) JOIN tfs USING (term) GROUP BY item_id, item_no, doc_id, row_no)
SELECT item_id, rank::INTEGER AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_no ORDER BY score DESC, doc_id NULLS LAST) AS rank
      FROM scored WHERE score > 0) WHERE rank <= 10
"""
