"""SimHash near-duplicates through a segment-popcount grid (operator 2).

A fingerprint's 64 bits are cut into segments; the bit counts of the segments are
its grid point.  Bits that differ change the counts by at least as little, so the
Manhattan distance of two points is a lower bound of the Hamming distance: pairs
farther apart than the limit need not be looked at.  Two points at Manhattan
distance 2 or less share a point within 1 of both, so every fingerprint is put in
its own cell and the cells one step away, and only fingerprints that share a cell
are verified bit by bit.

Equal fingerprints are one node.  A cell with more than ``cell_rows`` nodes (a
large group of near copies) is refined instead of compared pairwise: its nodes go
to the finest grid, one bit a segment, where sharing a cell already means two
different bits or fewer, and each node is linked to the smallest in the cell.  No
link is lost and no group's pairs are listed.

Null text is the empty text.  Texts without a word have fingerprint 0, linked like
any other.  Rows with a null doc_id keep their row; they link, but a component
without any doc_id has component_id null.  Repeated rows are kept.  An empty table
gives an empty result.  Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kbforge.llm.common import id_and_text, map_batches, save
from kbforge.llm.components import connected_components

MAX_BITS = 2
_ONES = np.uint64(0x0101010101010101)


def shingle_hashes(text: str, words: int = 3) -> np.ndarray:
    """Unsigned XXH64 (seed 42) of every shingle, repeats included."""
    import xxhash

    w = text.encode("utf-8", "surrogatepass").lower().split()   # bytes: A-Z only, ASCII white space only
    if not w:
        return np.zeros(0, np.uint64)
    if len(w) < words:
        parts = [b" ".join(w)]
    else:
        parts = map(b" ".join, zip(*(w[k:] for k in range(words))))
    h = xxhash.xxh64_intdigest
    return np.array([h(p, 42) for p in parts], np.uint64)


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of ``hashes`` have each bit set (index = bit), eight bits at a time in byte lanes."""
    counts = np.zeros(64, np.int64)
    padded = np.zeros(-(-len(hashes) // 255) * 255, np.uint64)
    padded[:len(hashes)] = hashes
    for k in range(8):
        lanes = ((padded >> np.uint64(k)) & _ONES).reshape(-1, 255).sum(axis=1, dtype=np.uint64)
        counts[k::8] = lanes.astype("<u8").view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
    return counts


def fingerprint(text: str, words: int = 3) -> int:
    """Signed 64-bit SimHash: a bit is set if over half the shingle hashes have it."""
    hashes = shingle_hashes(text, words)
    if not len(hashes):
        return 0
    bits = 2 * bit_counts(hashes) > len(hashes)
    return int(np.packbits(bits, bitorder="little").view("<i8")[0])


def text_hash(text: Column) -> Column:
    """Names a text beside its doc_id; null text is the empty text."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def fingerprints(docs: DataFrame, words: int = 3, hashes: bool = False) -> DataFrame:
    """(doc_id, fp long) for every row, with ``hashes`` also :func:`text_hash`."""
    def run(batch: pa.RecordBatch) -> dict:
        out = {"doc_id": batch.column(0), "fp": [fingerprint(t.as_py(), words) for t in batch.column(1)]}
        return out | ({"text_hash": batch.column(2)} if hashes else {})

    rows = id_and_text(docs)
    if hashes:
        rows = rows.withColumn("text_hash", text_hash(F.col("text")))
    return map_batches(rows, run, "doc_id long, fp long" + (", text_hash long" if hashes else ""))


def grid_cells(fp: Column, segments: int) -> Column:
    """Array of the packed bit counts of ``segments`` segments and of all points one step away."""
    size = 64 // segments
    field = size.bit_length()
    counts = [F.bit_count(F.shiftrightunsigned(fp, s * size).bitwiseAND(F.lit((1 << size) - 1).cast("long")))
              if size > 1 else F.shiftrightunsigned(fp, s).bitwiseAND(F.lit(1).cast("long"))
              for s in range(segments)]

    def signed(x: int) -> Column:
        x &= (1 << 64) - 1
        return F.lit(x - (1 << 64) if x >> 63 else x).cast("long")

    def put(s: int, count: Column) -> Column:
        return F.shiftleft(count.cast("long"), s * field)

    home = put(0, counts[0])
    for s in range(1, segments):
        home = home.bitwiseOR(put(s, counts[s]))

    def near(point: Column) -> Column:
        cells = [point]
        for s in range(segments):
            mask = ((1 << field) - 1) << (s * field)
            rest = point.bitwiseAND(signed(~mask))
            count = F.shiftrightunsigned(point, s * field).bitwiseAND(F.lit((1 << field) - 1).cast("long"))
            cells.append(F.when(count < size, rest.bitwiseOR(put(s, count + 1))))
            cells.append(F.when(count > 0, rest.bitwiseOR(put(s, count - 1))))
        return F.array_compact(F.array(*cells))

    # computed once, then reused by every neighbour
    return F.transform(F.array(home), near)[0]


def links(nodes: DataFrame, segments: int = 16, cell_rows: int = 48) -> DataFrame:
    """Verified links (u, v) that connect all different ``fp`` within two bits of each other."""
    # Spark sizes rows after an explode as those before it, so the join is told not to broadcast them; the
    # counts are written, so that both sides are exchanged and a crowded cell's rows can be split over tasks
    cells = nodes.select("fp", F.explode(grid_cells(F.col("fp"), segments)).alias("cell"))
    load = save(cells.groupBy("cell").agg(F.count("*").alias("n")).where("n > 1"), "cell-loads")
    shared = save(cells.hint("merge").join(load, "cell"), "cells")
    members = (shared.where(F.col("n") <= cell_rows).groupBy("cell").agg(F.collect_list("fp").alias("fps")))
    close = (members.select(F.explode("fps").alias("u"), "fps")
             .select("u", F.explode(F.filter("fps", lambda b: (b < F.col("u")) & (
                 F.bit_count(b.bitwiseXOR(F.col("u"))) <= MAX_BITS))).alias("v")))
    crowded = shared.where(F.col("n") > cell_rows).select("fp").distinct()
    fine = save(crowded.select("fp", F.explode(grid_cells(F.col("fp"), 64)).alias("cell")), "fine-cells")
    least = fine.groupBy("cell").agg(F.min("fp").alias("v"), F.count("*").alias("n")).where("n > 1")
    star = fine.hint("merge").join(least, "cell").where("fp <> v").select(F.col("fp").alias("u"), "v")
    return close.unionByName(star).distinct()


def near_duplicates(docs: DataFrame, words: int = 3, max_bits: int = MAX_BITS, hashes: bool = False) -> DataFrame:
    """(doc_id, fp, component_id, root): documents linked at ``max_bits`` (0 or 2) or fewer differing bits.

    ``root`` is the smallest fingerprint of the component, never null; ``hashes`` adds ``text_hash``.
    """
    if max_bits not in (0, MAX_BITS):
        raise ValueError("max_bits is 0 or 2")
    prints = save(fingerprints(docs, words, hashes), "fingerprints")
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("low"))
    if max_bits:
        roots = connected_components(links(nodes.select("fp")))
        nodes = (nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
                 .withColumn("root", F.coalesce("root", "fp")))
        low = nodes.groupBy("root").agg(F.min("low").alias("component_id"))
        nodes = nodes.select("fp", "root").join(low, "root").select("fp", "component_id", "root")
    else:
        nodes = nodes.select("fp", F.col("low").alias("component_id"), F.col("fp").alias("root"))
    return prints.join(nodes, "fp")


def as_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
