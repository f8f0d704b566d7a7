"""Phrase collocation mining by SETM relations (operator 13).

R1 is the relation of all word occurrences (piece, position, word), persisted in
the order of piece and position, a segment of documents a row.  R(k+1) comes from a
merge-join of Rk with itself on the same piece and the next position: two frequent
phrases of k words that overlap in k-1 make one of k+1, which needs no other
relation.  The occurrences are group-counted (inside the segment first, then over
all segments), infrequent groups go, and the rest is semi-joined back into the
segments, which leaves a shorter relation for the next length.  Infrequent words
and ends of pieces break a run of positions; nothing frequent spans them.

Phrases are group numbers during mining; a phrase of k words is the pair of its
first and last k-1 words, so the parts of every cut are reached over those links.
Words meet by a 128-bit hash of language and word.

A bucket receives a group once from each segment, however often it occurs, so no
word or phrase gathers its occurrences in one task.  A segment is bounded by
``SEGMENT_WORDS`` and one document.

Null text is empty, null lang is ``und``.  Repeated rows count each time.  An empty
table, or one without frequent phrases, gives an empty result.  Other columns
are not read.
"""

from __future__ import annotations

from array import array
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kbforge.llm.common import prepare, save
from kbforge.llm.packed import bucket_count, deal, flat, lists, mixed, offsets, runs, schema_of

MIN_COUNT = 10
MAX_WORDS = 3
TOP = 2000
SEGMENT_WORDS = 1_000_000
BREAK = b"\xff"             # no byte of UTF-8
_PIECES = bytes.maketrans(b".,;:!?\n\x0b\x0c\r\t", BREAK * 10 + b" ")

SEGMENT = "seg long, lang string, n long, words array<binary>, counts array<int>, codes array<int>"
RELATION = "seg long, lang string, codes array<int>, ids array<long>, named array<long>, words array<binary>"
DEALT = "bucket int, seg long, at array<int>, a array<long>, b array<long>, c array<int>"
COUNTED = "bucket long, seg long, at array<int>, g array<int>, lead array<boolean>, a array<long>, b array<long>, f array<long>"


def words_and_breaks(text: str) -> list[bytes]:
    """Words of a text in order, with ``BREAK`` between pieces and at the end."""
    data = text.encode("utf-8", "surrogatepass").lower().translate(_PIECES)
    return data.replace(BREAK, b" \xff ").split() + [BREAK]


class _Segment:
    """Occurrences of some documents of one language: codes of a local dictionary, -1 at breaks."""

    def __init__(self):
        self.codes = array("i")
        self.words: defaultdict = defaultdict()
        self.words.default_factory = self.words.__len__
        self.words[BREAK]

    def add(self, text: str) -> int:
        found = words_and_breaks(text)
        self.codes.extend(map(self.words.__getitem__, found))
        return len(found)

    def row(self, seg: int, lang: str) -> dict:
        codes = np.frombuffer(self.codes, np.int32) - 1
        counts = np.bincount(codes + 1, minlength=len(self.words))[1:]
        return {"seg": seg, "lang": lang, "n": int(counts.sum()), "words": list(self.words)[1:],
                "counts": counts.astype(np.int32), "codes": _squeezed(codes)}


def _squeezed(codes: np.ndarray) -> np.ndarray:
    """One break is as good as several in a row."""
    gap = codes < 0
    keep = ~gap
    keep[1:] |= gap[1:] & ~gap[:-1]
    return codes[keep]


def segments(docs: DataFrame) -> DataFrame:
    """R1, persisted: one row per segment of documents of a language."""
    target = schema_of(SEGMENT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, made = TaskContext.get().partitionId(), 0
        open_: dict[str, _Segment] = defaultdict(_Segment)
        held = 0

        def flush():
            nonlocal made, held
            for lang, s in open_.items():
                row = s.row((part << 24) + made, lang)
                made += 1
                yield pa.RecordBatch.from_arrays([pa.array([row[f.name]], f.type) for f in target], schema=target)
            open_.clear()
            held = 0

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                held += open_[lang].add(text.as_py())
                if held >= SEGMENT_WORDS:
                    yield from flush()
        yield from flush()

    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"),
                       F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return save(rows.mapInArrow(run, SEGMENT), "occurrences", long_rows=True)


def _deal_words(parts: int):
    """Each segment's words with their counts, as 128-bit keys, to their buckets."""
    target = schema_of(DEALT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            # the words of one segment are Python objects at a time, however many segments a batch has
            for seg, lang, words, counts in zip(*(batch.column(n) for n in ("seg", "lang", "words", "counts")), strict=True):
                lang = lang.as_py().encode("utf-8", "surrogatepass") + b"\x00"
                h = b"".join(xxhash.xxh3_128_digest(lang + w) for w in words.values.to_pylist())
                a, b = np.frombuffer(h, "<i8").reshape(-1, 2).T
                yield from deal(mixed(a, b) % np.uint64(parts), {
                    "at": np.arange(len(a), dtype=np.int32), "a": a, "b": b,
                    "c": np.asarray(counts.values)}, {"seg": seg.as_py()}, target)

    return run


def _neighbours(codes: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Merge-join of a sorted relation with itself on the next position of the same piece.

    Returns, for each element but the last, the local number of the pair it starts
    (-1 where a break is in the way), and of each distinct pair its ids and count.
    """
    left, right = codes[:-1], codes[1:]
    whole = (left >= 0) & (right >= 0)
    key = left[whole].astype(np.int64) * max(len(ids), 1) + right[whole]
    distinct, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
    pairs = np.full(len(left), -1, np.int32)
    pairs[whole] = inverse
    a, b = (ids[distinct // max(len(ids), 1)], ids[distinct % max(len(ids), 1)]) if len(ids) else (ids, ids)
    return pairs, a, b, count


def _deal_pairs(parts: int):
    target = schema_of(DEALT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for seg, codes, ids in zip(batch.column("seg").to_pylist(), batch.column("codes"), batch.column("ids"),
                                       strict=True):
                _, a, b, c = _neighbours(np.asarray(codes.values), np.asarray(ids.values))
                yield from deal(mixed(a, b) % np.uint64(parts), {
                    "at": np.arange(len(a), dtype=np.int32), "a": a, "b": b, "c": c}, {"seg": seg}, target)

    return run


def _count(dealt: DataFrame, min_count: int, give_back: bool) -> DataFrame:
    """Group-count of one bucket at a time.

    A frequent group is known by its bucket and a number in it.  Rows with ``seg`` -1 hold
    the frequent groups; with ``give_back`` the others tell
    each segment which of its groups are frequent, and for which it leads, one segment
    a group.
    """
    target = schema_of(COUNTED)

    def rows(bucket, seg, at, g, lead, ends, a=(), b=(), f=(), named=None) -> pa.Table:
        named = np.zeros(len(seg) + 1, np.int32) if named is None else named
        kind = {f.name: f.type for f in target}
        return pa.Table.from_arrays(
            [pa.array([bucket] * len(seg), pa.int64()), pa.array(seg, pa.int64()), lists(at, ends, kind["at"]),
             lists(g, ends, kind["g"]), lists(lead, ends, kind["lead"]),
             lists(a, named, kind["a"]), lists(b, named, kind["b"]), lists(f, named, kind["f"])], schema=target)

    def run(key, table):
        (at, ends), (a, _), (b, _), (c, _) = (flat(table[n]) for n in ("at", "a", "b", "c"))
        order = np.lexsort((b, a))
        start = runs(a[order], b[order])
        total = np.add.reduceat(c[order].astype(np.int64), start)
        good = np.flatnonzero(total >= min_count)
        bucket, g = key[0].as_py(), np.full(len(total), -1, np.int32)
        g[good] = np.arange(len(good), dtype=np.int32)
        named = offsets(np.array([len(good)]))
        head = order[start][good]
        out = [rows(bucket, [-1], g[good], g[good], np.zeros(len(good), bool), named, a[head], b[head], total[good], named)]
        if give_back:
            group = np.empty(len(order), np.int32)
            group[order] = np.repeat(g, np.diff(np.append(start, len(order))))
            lead = np.zeros(len(order), bool)
            lead[order[start]] = True
            back = group >= 0
            kept = np.diff(offsets(back)[ends])     # of each segment
            out.append(rows(bucket, table["seg"].to_numpy(), at[back], group[back], lead[back], offsets(kept)))
        return pa.concat_tables(out)

    return save(dealt.groupBy("bucket").applyInArrow(run, COUNTED), "groups", long_rows=True)


def _frequent(counted: DataFrame) -> DataFrame:
    """(gid, a, b, f) of the frequent groups."""
    return (counted.where("seg = -1").select("bucket", F.explode(F.arrays_zip("g", "a", "b", "f")).alias("x"))
            .select((F.shiftleft("bucket", 32) + F.col("x.g")).alias("gid"), "x.a", "x.b", "x.f"))


def _semi_join(relation: DataFrame, counted: DataFrame, first: bool) -> DataFrame:
    """The next relation: occurrences of frequent groups only, as codes of the segment's own list of groups."""
    target = schema_of(RELATION)

    def run(left, right):
        if not left.num_rows or not right.num_rows:
            return target.empty_table()
        codes = flat(left["codes"])[0]
        at, (g, ends) = flat(right["at"])[0], flat(right["g"])
        gid = np.repeat(np.asarray(right["bucket"]) << 32, np.diff(ends)) + g
        if first:
            n = len(left["words"][0])
        else:
            codes, known, _, _ = _neighbours(codes, flat(left["ids"])[0])
            n = len(known)
        number = np.full(n + 1, -1, np.int32)       # the last one is for breaks, code -1
        number[at] = np.arange(len(at), dtype=np.int32)
        codes = _squeezed(number[codes])
        lead = flat(right["lead"])[0] if first else np.zeros(len(at), bool)
        words = left["words"].combine_chunks().flatten().take(pa.array(at[lead])) if first else []
        one = lambda v, name: lists(v, offsets(np.array([len(v)])), target.field(name).type)
        return pa.Table.from_arrays([left["seg"], left["lang"], one(codes, "codes"), one(gid, "ids"),
                                     one(gid[lead], "named"), one(words, "words")], schema=target)

    back = counted.where("seg >= 0").select("bucket", "seg", "at", "g", "lead")
    columns = ["seg", "lang", "words", "codes"] if first else ["seg", "lang", "codes", "ids"]
    return save(relation.select(*columns).groupBy("seg").cogroup(back.groupBy("seg")).applyInArrow(run, RELATION),
                "relation", long_rows=True)


def _vocabulary(relation: DataFrame) -> DataFrame:
    """(gid, lang, word) of the frequent words, each from the segment that leads for it."""
    return (relation.select("lang", F.explode(F.arrays_zip("named", "words")).alias("g"))
            .select(F.col("g.named").alias("gid"), "lang", F.col("g.words").cast("string").alias("word")))


def mine(docs: DataFrame, min_count: int = MIN_COUNT, max_words: int = MAX_WORDS) -> tuple[DataFrame, list[DataFrame]]:
    """(words per lang (lang, n), frequent phrases of 1, 2, ... words).

    Words are (gid, lang, word, f), longer phrases (gid, a, b, f) with ``a`` and ``b``
    the groups of the first and last words but one.
    """
    prepare(docs.sparkSession)
    r1 = segments(docs)
    sizes = r1.groupBy("lang").agg(F.sum("n").alias("n"))
    keys, held = r1.agg(F.sum(F.size("words")), F.sum("n")).first()
    dealt = r1.select("seg", "lang", "words", "counts").mapInArrow(_deal_words(bucket_count(r1, keys or 0)), DEALT)
    counted = _count(dealt, min_count, True)
    relation = _semi_join(r1, counted, first=True)
    levels = [_frequent(counted).select("gid", "f").join(_vocabulary(relation), "gid")]
    for k in range(2, max_words + 1):
        parts = bucket_count(relation, (held or 0) // 2)
        counted = _count(relation.select("seg", "codes", "ids").mapInArrow(_deal_pairs(parts), DEALT), min_count,
                         k < max_words)
        levels.append(_frequent(counted))
        if k < max_words:
            relation = _semi_join(relation, counted, first=False)
    return sizes, levels


def collocations(docs: DataFrame, min_count: int = MIN_COUNT, max_words: int = MAX_WORDS, top: int = TOP,
                 inside_percent: int = 50) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first ``top`` phrases of 2 to ``max_words`` words."""
    sizes, levels = mine(docs, min_count, max_words)
    words = save(levels[0], "words")
    # first[j] / last[j]: count and text of the first / last j words of the phrases of the length at hand
    one = F.struct("f", F.col("word").alias("text"))
    known = words.select("gid", "lang", F.array(one).alias("first"), F.array(one).alias("last"))
    found, longer = [], []
    for k in range(2, max_words + 1):
        head = known.select(F.col("gid").alias("a"), "lang", F.col("first").alias("heads"))
        tail = known.select(F.col("gid").alias("b"), F.col("last").alias("tails"))
        level = save(levels[k - 1].join(head, "a").join(tail, "b").withColumn("phrase", F.concat_ws(
            " ", F.col("heads")[k - 2]["text"], F.substring_index(F.col("tails")[k - 2]["text"], " ", -1))), f"phrases{k}")
        whole = F.array(F.struct("f", F.col("phrase").alias("text")))
        known = level.select("gid", "lang", F.concat("heads", whole).alias("first"), F.concat("tails", whole).alias("last"))
        found.append(level)
        # every longer phrase that holds one of k words holds one of k + 1 that does, at least as often
        longer.append(level.select(F.explode(F.array("a", "b")).alias("gid"), F.col("f").alias("over"))
                      .groupBy("gid").agg(F.max("over").alias("over")))
    rows = []
    for k, level in enumerate(found, start=2):
        cuts = F.array(*[_cut(j, F.col("heads")[j - 1]["f"], F.col("tails")[k - j - 1]["f"]) for j in range(1, k)])
        if k < max_words:
            level = (level.join(longer[k - 1], "gid", "left")
                     .where(F.col("over").isNull() | (100 * F.col("over") < inside_percent * F.col("f"))))
        rows.append(level.select("lang", "phrase", F.col("f").alias("a"), F.array_min(cuts).alias("cut")))
    ranked = reduce(DataFrame.unionByName, rows).join(sizes, "lang")
    order = Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), F.asc("phrase"))
    return (ranked.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
            .select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "cut.l", "cut.r", "n", "cut.score"))


def _cut(j: int, left: Column, right: Column) -> Column:
    """(score, j, l, r) of the cut after ``j`` words; products in decimals, exact for counts below 10**15."""
    def times(x: Column, y: Column) -> Column:
        return (x.cast("decimal(15,0)") * y.cast("decimal(15,0)")).cast("decimal(38,0)")

    score = F.call_function("div", times(F.col("f"), F.col("f")) * F.lit(1_000_000).cast("decimal(38,0)"),
                            times(left, right))
    return F.struct(score.cast("long").alias("score"), F.lit(j).alias("j"), left.alias("l"), right.alias("r"))


# The same by counting all phrases; ASCII letters only are lower-cased.
PHRASES_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, doc_id, rowid_, regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[.,;:!?\x0A-\x0D]') AS ps
  FROM (SELECT lang, doc_id, text, row_number() OVER () AS rowid_ FROM documents)),
words AS (
  SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w
  FROM (SELECT lang, unnest(ps) AS p FROM pieces)),
grams AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase
  FROM (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM words), (SELECT unnest([1, 2, 3]) AS k)
  WHERE i + k - 1 <= len(w)),
f AS (SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
cand AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k >= 2 AND f >= 10),
cuts AS (
  SELECT c.lang, c.k, c.phrase, c.a, j, x.f AS l, y.f AS r,
         ((1000000::HUGEINT * c.a * c.a) // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM (SELECT *, unnest(range(1, k)) AS j FROM cand) c
  JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:j], ' ')
  JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[j + 1:c.k], ' ')),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
inside AS (
  SELECT DISTINCT b.lang, b.phrase FROM best b JOIN (
    SELECT lang, a, array_to_string(w[s:s + 1], ' ') AS part FROM (SELECT *, unnest([1, 2]) AS s FROM cand WHERE k = 3)) t
  ON t.lang = b.lang AND t.part = b.phrase AND b.k = 2 AND 100 * t.a >= 50 * b.a),
ranked AS (
  SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank,
         phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, score
  FROM best ANTI JOIN inside USING (lang, phrase))
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN n USING (lang) WHERE rank <= 2000
"""
