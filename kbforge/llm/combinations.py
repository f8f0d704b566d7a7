"""N-gram Jaccard join through token-combination prefixes (operator 11).

A document's set is its distinct 4-word shingles (the tokens).  Two sets of n and n'
tokens link when 100 * shared >= 85 * all; then at most ``slack`` = 15 n div 100
tokens of the first are missing from the second.

All tokens are ordered from rare to frequent and belong to classes by their
document frequency: tokens of class 1 are indexed alone, of class 2 in pairs, of
class 3 in triples.  A class of k-combinations with c tokens in a set's prefix
covers max(0, c - k + 1) missing tokens: that many can be missing before no
k-combination is left.  A prefix is extended until its classes cover slack + 1, so
two linked sets share a whole combination.  Classes 2 and 3 are cut into sub-classes
by the token's hash, so that combinations stay few; how many depends on the size of
the smaller set (a power of two), which both sides can tell, so a set is indexed for
its own power of two and, if it can be the larger side, for the one below.  Sets
below 8 tokens are indexed by single tokens.

A token no other set has can only be missing, so it is counted and never indexed or
verified, and a set with more than ``slack`` of them has no link.

Sets that share a combination are candidates; size and the counts of shared tokens
rule out most, and the rest is verified exactly.  A combination that more than
``HOT`` sets share is not taken pair by pair: its sets are verified against three of
them, and then only those that this left outside the largest component of the
combination are verified against its other sets, in blocks.  Combinations of one
largest component are taken together.  Sets already
connected need no link of their own, so components come out as if all pairs had been
verified.

Equal sets are one node, named by a 64-bit hash; a second hash shows if two different
sets should ever share a name, and other names are taken.  Tokens are 64-bit hashes.

Null text is the empty text.  Documents without a word link with nothing, not even
with each other.  Rows with a null doc_id keep their row; a component without any
doc_id has component_id null.  Repeated rows are kept.  An empty table gives an empty
result.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kbforge.llm.common import id_and_text, prepare, save
from kbforge.llm.components import connected_components
from kbforge.llm.packed import bucket_count, deal, flat, lists, mixed, offsets, runs, schema_of

WORDS = 4
PERCENT = 85
CLASS_DF = (32, 4096)       # largest document frequency of class 1 and of class 2
SUBCLASS = 3                # missing tokens a sub-class is meant to cover
SMALL = 8                   # smaller sets use single tokens only
HOT = 32
BLOCK = 256                 # sets of one side of a verified block
BUCKET_TOKENS = 3_000_000   # tokens a bucket is meant to receive
HOT_SHARE = 200             # tokens in one of so many sets travel with their sets

SETS = "doc_id long, key long, check long, n int, hot array<long>, hot_df array<long>"
POSTINGS = "bucket int, key array<long>, n array<int>, count array<int>, token array<long>"
SHARED = "bucket int, key array<long>, n array<int>, count array<int>, token array<long>, df array<int>"
SURVIVORS = "key long, n int, s int, token array<long>, sig array<long>"


class _Hashes(dict):
    """Unsigned 64-bit hashes of words, remembered."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= 300_000:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def tokens(text: str, known: _Hashes, words: int = WORDS) -> np.ndarray:
    """The set of a text: sorted distinct signed hashes of its shingles."""
    found = text.encode("utf-8", "surrogatepass").lower().split()   # bytes: A-Z only, ASCII white space only
    if not found:
        return np.zeros(0, np.int64)
    h = np.fromiter(map(known.__getitem__, found), np.uint64, len(found))
    span = min(words, len(h))
    total = np.full(len(h) - span + 1, span, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(span):
            total = total * np.uint64(0x9E3779B97F4A7C15) + h[k:len(h) - span + 1 + k]
    return np.unique(mixed(total).view(np.int64))


def _name(token: np.ndarray, seed: int) -> tuple[int, int]:
    import xxhash

    return tuple(np.frombuffer(xxhash.xxh3_128_digest(token.tobytes(), seed), "<i8").tolist())


def _sets(docs: DataFrame, words: int, seed: int) -> DataFrame:
    """A row per document, and per batch a row with its very common tokens."""
    target = schema_of(SETS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Hashes()
        for batch in batches:
            found = [tokens(t.as_py(), known, words) for t in batch.column(1)]
            names = [_name(t, seed) for t in found]
            n = len(found)
            none = pa.array([None] * n, target.field("hot").type)
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array([a for a, _ in names], pa.int64()), pa.array([b for _, b in names], pa.int64()),
                pa.array([len(t) for t in found], pa.int32()), none, none], schema=target)
            distinct = {a: t for (a, _), t in zip(names, found, strict=True)}
            if not distinct:
                continue
            token, df = np.unique(np.concatenate(list(distinct.values())), return_counts=True)
            common = df >= max(20, len(distinct) // (HOT_SHARE // 2))
            one = offsets(np.array([common.sum()]))
            yield pa.RecordBatch.from_arrays([
                pa.array([None], pa.int64()), pa.array([None], pa.int64()), pa.array([None], pa.int64()),
                pa.array([-1], pa.int32()), lists(token[common], one, target.field("hot").type),
                lists(df[common], one, target.field("hot_df").type)], schema=target)

    return save(id_and_text(docs).mapInArrow(run, SETS), "sets")


def _hot_tokens(sets: DataFrame, nodes: int) -> tuple[np.ndarray, np.ndarray]:
    """Tokens that at least one in ``HOT_SHARE`` sets has, with what was counted of them, sorted.

    Their number is at most ``HOT_SHARE`` times the mean size of a set.
    """
    rows = (sets.where("n = -1").select(F.explode(F.arrays_zip("hot", "hot_df")).alias("h")).groupBy("h.hot")
            .agg(F.sum("h.hot_df").alias("df")).where(F.col("df") >= max(64, nodes // HOT_SHARE)).orderBy("hot").toArrow())
    return np.asarray(rows["hot"]).astype(np.int64), np.asarray(rows["df"]).astype(np.int64)


def _is_in(sorted_values: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(sorted_values):
        return np.zeros(len(x), bool), np.zeros(len(x), np.int64)
    at = np.minimum(np.searchsorted(sorted_values, x), len(sorted_values) - 1)
    return sorted_values[at] == x, at


def _deal_sets(bucket: np.ndarray, key: np.ndarray, n: np.ndarray, columns: dict[str, np.ndarray],
               target: pa.Schema) -> Iterator[pa.RecordBatch]:
    """One row per bucket: its sets, how many tokens it gets of each, and those tokens."""
    if not len(bucket):
        return
    order = np.lexsort((key, bucket))
    bucket, key, n = bucket[order], key[order], n[order]
    own = runs(bucket, key)                         # sets within buckets
    first = runs(bucket)
    sets_end = np.append(np.searchsorted(own, first), len(own)).astype(np.int32)
    tokens_end = np.append(first, len(order)).astype(np.int32)
    count = np.diff(np.append(own, len(order)))
    out = []
    for f in target:
        if f.name == "bucket":
            out.append(pa.array(bucket[first], f.type))
        elif f.name in columns:
            out.append(lists(columns[f.name][order], tokens_end, f.type))
        else:
            out.append(lists({"key": key[own], "n": n[own], "count": count}[f.name], sets_end, f.type))
    yield pa.RecordBatch.from_arrays(out, schema=target)


def _postings(docs: DataFrame, words: int, seed: int, parts: int, hot: np.ndarray) -> DataFrame:
    """Tokens with their sets, to buckets by token; very common tokens to buckets by set."""
    target = schema_of(POSTINGS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, seen = _Hashes(), set()              # equal sets of a task go once
        for batch in batches:
            own, named = [], []
            for text in batch.column(1):
                t = tokens(text.as_py(), known, words)
                key = _name(t, seed)[0]
                if len(t) and key not in seen:
                    seen.add(key)
                    own.append(t)
                    named.append(key)
            if not own:
                continue
            sizes = np.array([len(t) for t in own])
            token, key, n = np.concatenate(own), np.repeat(named, sizes), np.repeat(sizes, sizes)
            bucket = np.where(_is_in(hot, token)[0], mixed(key), mixed(token)) % np.uint64(parts)
            yield from _deal_sets(bucket, key, n, {"token": token}, target)

    return id_and_text(docs).mapInArrow(run, POSTINGS)


def _shared_tokens(postings: DataFrame, groups: int, hot: np.ndarray, hot_df: np.ndarray) -> DataFrame:
    """Document frequency of every token of a bucket; those of two sets or more go back to their sets."""
    target = schema_of(SHARED)

    def run(_key, table):
        named, size, count = (flat(table[c])[0] for c in ("key", "n", "count"))
        token = flat(table["token"])[0]
        _, once = np.unique(named, return_index=True)       # a set met by several tasks counts once
        first = np.zeros(len(named), bool)
        first[once] = True
        owner = np.repeat(np.arange(len(named), dtype=np.int32), count)
        if not first.all():
            keep = first[owner]
            owner, token = owner[keep], token[keep]
        order = np.argsort(token, kind="stable")
        start = runs(token[order])
        length = np.diff(np.append(start, len(order)))
        df = np.empty(len(token), np.int32)
        df[order] = np.repeat(length, length)
        common, at = _is_in(hot, token)
        df[common] = np.minimum(hot_df[at[common]], np.iinfo(np.int32).max)
        back = np.flatnonzero(df > 1)
        key = named[owner[back]]
        rows = list(_deal_sets(mixed(key) % np.uint64(groups), key, size[owner[back]],
                               {"token": token[back], "df": df[back]}, target))
        return pa.Table.from_batches(rows, schema=target)

    return postings.groupBy("bucket").applyInArrow(run, SHARED)


def slack(n: int, percent: int = PERCENT) -> int:
    """How many tokens of a set of ``n`` a linked set may lack."""
    return n - -(-percent * n // 100)


@cache
def _choose(n: int, k: int) -> np.ndarray:
    return np.array(list(combinations(range(n), k)), np.int64).reshape(-1, k)


def signatures(n: int, token: np.ndarray, df: np.ndarray, percent: int = PERCENT,
               class_df: tuple = CLASS_DF) -> np.ndarray:
    """Hashes of the combinations that index a set of ``n`` tokens; ``token`` are those it shares, rare ones first."""
    out = []
    need = slack(n, percent) + 1 - (n - len(token))
    top = n.bit_length() - 1
    for scheme in {top, (-(-percent * n // 100)).bit_length() - 1}:
        if scheme < SMALL.bit_length() - 1:
            prefix = token[:need]
            out.append(mixed(prefix, scheme))
            continue
        parts = max(1, slack(1 << scheme, percent) // SUBCLASS)
        k = 1 + (df > class_df[0]) + (df > class_df[1])
        sub = np.where(k == 1, 0, mixed(token, 7) % np.uint64(parts)).astype(np.int64) + (k << 32)
        # how many tokens of the same sub-class come before each: the first k - 1 cover nothing
        order = np.argsort(sub, kind="stable")
        start = runs(sub[order])
        length = np.diff(np.append(start, len(order)))
        place = np.empty(len(sub), np.int64)
        place[order] = np.arange(len(sub)) - np.repeat(start, length)
        covered = np.cumsum(place >= k - 1)
        end = int(np.searchsorted(covered, need)) + 1
        single = k[:end] == 1
        out.append(mixed(token[:end][single], scheme))
        for s in np.unique(sub[:end][~single]):
            t = np.sort(token[:end][sub[:end] == s])
            width = int(s >> 32)
            if len(t) < width:
                continue
            chosen = t[_choose(len(t), width)]
            h = np.full(len(chosen), scheme * 4 + width, np.uint64)
            for c in range(width):
                h = mixed(chosen[:, c], h)
            out.append(h)
    return np.unique(np.concatenate(out).view(np.int64))


def _survivors(shared: DataFrame, percent: int) -> DataFrame:
    """Sets with few enough tokens of their own: (key, n, s, shared tokens, signatures)."""
    target = schema_of(SURVIVORS)

    def run(_key, table):
        count = flat(table["count"])[0]
        key, n = np.repeat(flat(table["key"])[0], count), np.repeat(flat(table["n"])[0], count)
        token, df = flat(table["token"])[0], flat(table["df"])[0]
        order = np.lexsort((token, df, key))
        key, n, token, df = key[order], n[order], token[order], df[order]
        start = runs(key)
        out = {f.name: [] for f in target}
        for i, j in zip(start.tolist(), [*start[1:].tolist(), len(key)], strict=True):
            size = int(n[i])
            if size - (j - i) > slack(size, percent):
                continue
            for name, v in zip(out, (key[i], size, j - i, np.sort(token[i:j]),
                                     signatures(size, token[i:j], df[i:j], percent)), strict=True):
                out[name].append(v)
        return pa.Table.from_arrays([pa.array(out[f.name], f.type) for f in target], schema=target)

    return save(shared.groupBy("bucket").applyInArrow(run, SURVIVORS), "survivors")


def _can_link(s1: Column, n1: Column, s2: Column, n2: Column, percent: int) -> Column:
    """Whether the tokens shared with any set leave room for a link."""
    return (100 + percent) * F.least(s1, s2, n1, n2) >= percent * (n1 + n2)


def _verified(pairs: DataFrame, survivors: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) that link, by the sizes of their sets and of what they share."""
    side = lambda name: survivors.select(F.col("key").alias(name), F.col("n").alias(f"n_{name}"),
                                         F.col("token").alias(f"token_{name}"))
    both = pairs.join(side("u"), "u").join(side("v"), "v")
    common = F.size(F.array_intersect("token_u", "token_v"))
    return both.where((100 + percent) * common >= percent * (F.col("n_u") + F.col("n_v"))).select("u", "v")


def _by_combination(survivors: DataFrame, percent: int, hot: int) -> tuple[DataFrame, DataFrame]:
    """(candidate pairs of all combinations, members of the combinations that more than ``hot`` sets share)."""
    rows = survivors.select(F.explode("sig").alias("sig"), "key", "n", "s")
    # sets that share most of their tokens link with most others: the best of each third of a combination's sets
    third = F.pmod(F.xxhash64("key"), F.lit(3))
    best = [F.max(F.when(third == i, F.struct("s", "key", "n"))).alias(f"p{i}") for i in range(3)]
    load = (rows.groupBy("sig").agg(F.count("*").alias("m"), *best, F.min("n").alias("least_n"), F.max("n").alias("most_n"))
            .where("m > 1"))
    members = save(rows.join(load.select("sig", "m", "least_n", "most_n", F.when(
        F.col("m") > hot, F.array_compact(F.array("p0", "p1", "p2"))).alias("pivots")), "sig"), "combinations")
    able = lambda x: _can_link(F.col("one.s"), F.col("one.n"), x["s"], x["n"], percent)
    few = (members.where(F.col("m") <= hot).groupBy("sig").agg(F.collect_list(F.struct("key", "n", "s")).alias("all"))
           .select("all", F.explode("all").alias("one"))
           .select(F.col("one.key").alias("u"), F.explode(F.filter("all", lambda x: (x["key"] < F.col("one.key")) & able(x)))
                   .alias("other")).select("u", F.col("other.key").alias("v")))
    many = members.where(F.col("m") > hot)
    # combinations of one set mostly have the same pivots: gathered by set before they are listed
    stars = (many.groupBy("key", "n", "s").agg(F.array_distinct(F.flatten(F.collect_set("pivots"))).alias("pivots"))
             .select(F.struct("key", "n", "s").alias("one"), "pivots")
             .select("one.key", F.explode(F.filter("pivots", lambda x: (x["key"] != F.col("one.key")) & able(x))).alias("other"))
             .select(F.greatest("key", "other.key").alias("u"), F.least("key", "other.key").alias("v")))
    return few.unionByName(stars).distinct(), many


def _left_outside(many: DataFrame, roots: DataFrame, survivors: DataFrame, percent: int) -> DataFrame:
    """Links between sets of a hot combination that are not connected yet.

    Members outside a combination's largest component meet all its members.  As
    combinations with the same largest component have mostly the same members, they
    are taken together: each outside member once against every member, in blocks of
    about ``BLOCK`` by ``BLOCK`` sets.
    """
    # the partner of the best size for a set's shared tokens: if that cannot link, none can
    best = F.greatest(F.least("s", "most_n"), "least_n")
    able = many.where(_can_link(F.col("s"), F.col("n"), best, best, percent))
    named = (able.join(roots.select(F.col("node").alias("key"), "root"), "key", "left")
             .select("sig", "key", F.coalesce("root", "key").alias("root")))
    held = named.groupBy("sig", "root").agg(F.count("*").alias("c"))
    mode = (held.groupBy("sig").agg(F.max_by("root", F.struct("c", "root")).alias("main"), F.count("*").alias("roots"))
            .where("roots > 1"))
    met = save(named.join(mode.select("sig", "main"), "sig").select("main", "key", "root").distinct(), "outside")
    blocks = lambda n: F.ceil(n / F.lit(BLOCK)).cast("int")
    sizes = (met.groupBy("main").agg(F.count("*").alias("m"), F.count_if(F.col("root") != F.col("main")).alias("o"))
             .select("main", blocks(F.col("o")).alias("lefts"), blocks(F.col("m")).alias("rights")))
    split = met.join(sizes, "main")
    number = lambda n: F.pmod(F.xxhash64("key"), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    left = (split.where("root <> main").withColumn("l", number(F.col("lefts"))).withColumn("r", every(F.col("rights")))
            .withColumn("outside", F.lit(True)))
    right = (split.withColumn("r", number(F.col("rights"))).withColumn("l", every(F.col("lefts")))
             .withColumn("outside", F.lit(False)))
    columns = ["main", "l", "r", "outside", "key", "root"]
    sides = (left.select(*columns).unionByName(right.select(*columns))
             .join(survivors.select("key", "n", "token"), "key"))
    target = schema_of("u long, v long")

    def run(_key, table):
        rows = table.select(["n", "key", "root", "outside"]).to_pydict()
        n, key, root = (np.array(rows[c]) for c in ("n", "key", "root"))
        token, ends = flat(table["token"])
        side = np.array(rows["outside"], bool)
        a, b = np.flatnonzero(side), np.flatnonzero(~side)
        if not len(a) or not len(b):
            return target.empty_table()
        shared = _overlaps(token, ends, a, b)
        total = n[a][:, None] + n[b][None, :]
        link = ((100 + percent) * shared >= percent * total) & (root[a][:, None] != root[b][None, :])
        u, v = np.nonzero(link)
        # one link for each pair of components is enough
        pair = np.stack([np.minimum(root[a][u], root[b][v]), np.maximum(root[a][u], root[b][v])], axis=1)
        _, once = np.unique(pair, axis=0, return_index=True) if len(pair) else (None, np.zeros(0, np.int64))
        return pa.Table.from_arrays([pa.array(key[a][u[once]], pa.int64()), pa.array(key[b][v[once]], pa.int64())], schema=target)

    return sides.groupBy("main", "l", "r").applyInArrow(run, "u long, v long")


def _overlaps(token: np.ndarray, ends: np.ndarray, a: np.ndarray, b: np.ndarray, width: int = 4096) -> np.ndarray:
    """How many tokens each set of ``a`` shares with each of ``b``, some of the vocabulary at a time."""
    vocabulary, code = np.unique(token, return_inverse=True)
    owner = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
    out = np.zeros((len(a), len(b)), np.float32)
    place = np.full(len(ends) - 1, -1)
    place[a], place_b = np.arange(len(a)), np.full(len(ends) - 1, -1)
    place_b[b] = np.arange(len(b))
    order = np.argsort(code, kind="stable")
    for low in range(0, len(vocabulary), width):
        i, j = np.searchsorted(code[order], [low, low + width])
        c, o = code[order[i:j]] - low, owner[order[i:j]]
        x, y = np.zeros((len(a), width), np.float32), np.zeros((len(b), width), np.float32)
        in_a, in_b = place[o] >= 0, place_b[o] >= 0
        x[place[o][in_a], c[in_a]] = 1
        y[place_b[o][in_b], c[in_b]] = 1
        out += x @ y.T
    return out.astype(np.int64)


def _named_sets(docs: DataFrame, words: int) -> tuple[DataFrame, DataFrame, int]:
    """(row per document, row per different set, seed of the names) with names that tell all sets apart."""
    for seed in range(8):
        sets = _sets(docs, words, seed)
        nodes = save(sets.where("n > 0").groupBy("key").agg(
            F.min("doc_id").alias("low"), F.max("n").alias("n"),
            (F.min("check") != F.max("check")).alias("mixed")), "set-nodes")
        if not nodes.where("mixed").take(1):
            return sets, nodes, seed
    raise RuntimeError("no seed names all sets differently")


def jaccard_links(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, hot: int = HOT
                  ) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(row per document, row per different set, (node, root) of the sets that link with another)."""
    prepare(docs.sparkSession)
    sets, nodes, seed = _named_sets(docs, words)
    count, total = nodes.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    hot_token, hot_df = _hot_tokens(sets, count)
    parts = bucket_count(docs, total, BUCKET_TOKENS)
    postings = _postings(docs, words, seed, parts, hot_token)
    survivors = _survivors(_shared_tokens(postings, parts, hot_token, hot_df), percent)
    pairs, many = _by_combination(survivors, percent, hot)
    links = save(_verified(pairs, survivors, percent), "jaccard-links")
    roots = save(connected_components(links), "jaccard-roots")
    more = save(_left_outside(many, roots, survivors, percent), "jaccard-more")
    if more.take(1):
        # the components found so far, as links of their roots
        roots = save(connected_components(more.unionByName(roots.select(F.col("node").alias("u"), F.col("root").alias("v")))),
                     "jaccard-roots")
    return sets, nodes, roots


def similar_documents(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, hot: int = HOT) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``docs``."""
    sets, nodes, roots = jaccard_links(docs, words, percent, hot)
    rooted = (nodes.join(roots.withColumnRenamed("node", "key"), "key", "left")
              .select("key", "low", F.coalesce("root", "key").alias("root")))
    low = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    known = rooted.select("key", "root").join(low, "root").select("key", "component_id")
    rows = sets.where("n >= 0")
    return (rows.where("n > 0").join(known, "key")
            .select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id")
            .unionByName(rows.where("n = 0").select("doc_id", F.lit(0).cast("long").alias("n_shingles"),
                                                    F.col("doc_id").alias("component_id"))))
