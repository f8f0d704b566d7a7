"""Token ids in bit-plane shuffled chunks (operator 1).

File format.  ``<path>/chunks`` is a Parquet table with one row per chunk of at
most ``chunk_ids`` token ids of one shard: the ids, as little-endian unsigned
32-bit integers, are transposed into 4 byte planes (or 32 bit planes), each plane
is compressed with zstandard, and the compressed planes are stored back to back
in ``payload`` with their lengths in ``plane_bytes``.  ``doc_ids`` and
``doc_ends`` list the documents with ids in the chunk and where each one's part
ends; ``first_doc`` is the ordinal, in the shard, of the first one, so a document
that spans chunks keeps its ordinal.  ``<path>/index`` is the chunk index: for
each (shard, chunk) the global position of its first id, the number of ids and
the plane lengths.  A chunk can be decoded alone.

Shards are ranges of (doc_id, text hash), so ids follow ascending doc_id over the
shards.  Null doc_ids come first.  Null text is the empty text; every document
ends with ``end_id``, so an empty one has exactly one id.  Repeated rows are
separate documents.  An empty table gives empty tables.  Other columns are not
read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from kbforge.llm.common import id_and_text, map_batches

CHUNK_IDS = 1 << 16
MAX_UNITS = 800_000         # pieces of a generation that a worker remembers, about 300 bytes each
CHUNK_SCHEMA = ("shard int, chunk int, first_id long, n_ids int, first_doc long, bits boolean, "
                "plane_bytes array<int>, payload binary, doc_ids array<long>, doc_ends array<int>")

_BEFORE_SPACED = re.compile(r"(?= \S)")
_ODD_SPACE = re.compile(r" (?:\s|$)")
# Texts and units without other characters are split here as the tokenizer splits them; on these its rule and Python's
# classes agree.
_OTHER = re.compile("[^\x20-\x7e\\n\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]")
_PIECES = re.compile("'(?:s|t|re|ve|m|ll|d)| ?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+| ?[0-9]+"
                     "| ?[^\\sA-Za-z0-9\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+|\\s+(?!\\S)|\\s+")


def _byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte: printable ones stand for themselves."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + n) for n, b in enumerate(rest)}


class _Pieces(dict):
    """Ids of pieces, by the model alone, remembered in two generations of bounded size.

    A full dictionary becomes the old generation, from which what recurs is taken over.
    """

    def __init__(self, tokenizer, size: int):
        self.size, self.old = max(1, size), {}
        self.tokenize, self.letters = tokenizer.model.tokenize, _byte_letters()
        self.space = self.letters[0x20]
        self.four = [k.to_bytes(4, "little") for k in range(tokenizer.get_vocab_size())]

    def __missing__(self, piece: str) -> bytes:
        ids = self.old.get(piece)
        if ids is None:
            four = self.four
            if piece.isascii() and piece.isprintable():             # all but the space stand for themselves
                letters = piece.replace(" ", self.space)
            else:
                letters = piece.encode().decode("latin-1").translate(self.letters)
            ids = b"".join([four[t.id] for t in self.tokenize(letters)])
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        self[piece] = ids
        return ids

    def of(self, text: str) -> bytes:
        """Ids of a plain text, or of a plain part that begins where a piece begins."""
        return b"".join(map(self.__getitem__, _PIECES.findall(text)))


class _Units(dict):
    """Ids of units, remembered as pieces are.

    A unit is what lies between two spaces, so that a space is part of its first piece.
    """

    def __init__(self, tokenizer, pieces: _Pieces, size: int):
        self.size, self.old, self.pieces, self.tokenizer = max(1, size), {}, pieces, tokenizer

    def library(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def __missing__(self, unit: str) -> bytes:
        ids = self.old.get(unit)
        if ids is None:
            ids = self.start(" " + unit)
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        self[unit] = ids
        return ids

    def start(self, text: str) -> bytes:
        """Ids of a unit with its space, or of what a text begins with before its first cut."""
        return self.library(text) if _OTHER.search(text) else self.pieces.of(text)


class UnitEncoder:
    """Byte-level BPE ids of whole texts, remembering the ids of recurring units.

    A text of ASCII and Latin letters is split into pieces by the tokenizer's own rule;
    pieces are encoded independently, and unknown ones go to the model of the
    ``tokenizers`` library.  The rule always starts a new piece at a space that is
    followed by a non-space, so a text with other characters is cut at those spaces
    into units; those with other characters go to the library as they are.  Pieces and
    units are looked up in bounded dictionaries.  A text in which a special token of the
    file is written out goes to the library whole.
    """

    def __init__(self, path: str, max_units: int = MAX_UNITS):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
        self.pieces = _Pieces(tokenizer, max_units)
        self.units = _Units(tokenizer, self.pieces, max_units // 4)

    def encode(self, text: str) -> bytes:
        """The ids of ``text`` as little-endian unsigned 32-bit integers."""
        for s in self.special:
            if s in text:
                return self.units.library(text)
        if not _OTHER.search(text):
            return self.pieces.of(text)
        if _ODD_SPACE.search(text):
            # a space run or a space before other white space: cut at the spaced words only
            first, *units = _BEFORE_SPACED.split(text)
            units = [u[1:] for u in units]
        else:
            first, *units = text.split(" ")
        return self.units.start(first) + b"".join(map(self.units.__getitem__, units))


_ENCODERS: dict[tuple[str, int], UnitEncoder] = {}


def encoder(path: str, max_units: int = MAX_UNITS) -> UnitEncoder:
    """One encoder per worker process, vocabulary file and size of its memory."""
    key = path, max_units
    if key not in _ENCODERS:
        _ENCODERS[key] = UnitEncoder(path, max_units)
    return _ENCODERS[key]


def to_planes(ids: np.ndarray, bits: bool) -> list[bytes]:
    """Byte planes (4) or bit planes (32) of little-endian unsigned 32-bit ids."""
    by_byte = np.ascontiguousarray(ids.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    if not bits:
        return [p.tobytes() for p in by_byte]
    return [np.packbits((plane >> k) & 1).tobytes() for plane in by_byte for k in range(8)]


def from_planes(planes: list[bytes], n_ids: int, bits: bool) -> np.ndarray:
    if bits:
        rows = []
        for b in range(4):
            plane = np.zeros(n_ids, np.uint8)
            for k in range(8):
                plane |= np.unpackbits(np.frombuffer(planes[8 * b + k], np.uint8), count=n_ids) << k
            rows.append(plane)
    else:
        rows = [np.frombuffer(p, np.uint8) for p in planes]
    return np.ascontiguousarray(np.stack(rows, axis=1)).reshape(-1).view("<u4") if n_ids else np.zeros(0, "<u4")


def pack_chunk(ids: np.ndarray, bits: bool, level: int) -> tuple[list[int], bytes]:
    squeeze = zstandard.ZstdCompressor(level=level)
    parts = [squeeze.compress(p) for p in to_planes(ids, bits)]
    return [len(p) for p in parts], b"".join(parts)


def unpack_chunk(payload: bytes, plane_bytes: list[int], n_ids: int, bits: bool) -> np.ndarray:
    expand, at, planes = zstandard.ZstdDecompressor(), 0, []
    for n in plane_bytes:
        planes.append(expand.decompress(payload[at:at + n]))
        at += n
    return from_planes(planes, n_ids, bits)


class _ShardWriter:
    """Cuts the id stream of one shard into chunks."""

    def __init__(self, shard: int, chunk_ids: int, bits: bool, level: int):
        self.shard, self.chunk_ids, self.bits, self.level = shard, chunk_ids, bits, level
        self.chunk = self.first_id = self.next_doc = self.first_doc = self.n = 0
        self.parts: list[bytes] = []
        self.doc_ids: list = []
        self.doc_ends: list[int] = []

    def add(self, doc_id, ids: bytes) -> Iterator[dict]:
        at, total = 0, len(ids) // 4
        if not self.doc_ids:
            self.first_doc = self.next_doc
        while True:
            take = min(total - at, self.chunk_ids - self.n)
            self.parts.append(ids[4 * at:4 * (at + take)])
            self.n += take
            at += take
            self.doc_ids.append(doc_id)
            self.doc_ends.append(self.n)
            if self.n == self.chunk_ids:
                yield self.flush()
                if at < total:
                    self.first_doc = self.next_doc
                    continue
            break
        self.next_doc += 1

    def flush(self) -> dict:
        plane_bytes, payload = pack_chunk(np.frombuffer(b"".join(self.parts), "<u4"), self.bits, self.level)
        row = {"shard": self.shard, "chunk": self.chunk, "first_id": self.first_id, "n_ids": self.n,
               "first_doc": self.first_doc, "bits": self.bits, "plane_bytes": plane_bytes, "payload": payload,
               "doc_ids": self.doc_ids, "doc_ends": self.doc_ends}
        self.chunk += 1
        self.first_id += self.n
        self.n, self.parts, self.doc_ids, self.doc_ends = 0, [], [], []
        return row


def write_ids(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 0, bits: bool = False,
              chunk_ids: int = CHUNK_IDS, level: int = 3, max_units: int = MAX_UNITS) -> None:
    """Encode every document and write ``<path>/chunks`` and ``<path>/index``.

    One shuffle of the documents by range of (doc_id, text hash); the id stream of
    a range is cut into chunks as it is made, so a task holds one Arrow batch and
    one chunk.  A worker remembers up to twice ``max_units`` pieces, and a quarter as many units:
    fewer take less memory and more time, and give the same ids.  Parquet's commit protocol makes retried tasks safe.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    target = to_arrow_schema(StructType.fromDDL(CHUNK_SCHEMA))
    end = np.asarray([end_id], "<u4").tobytes()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        writer = _ShardWriter(TaskContext.get().partitionId(), chunk_ids, bits, level)
        ids_of = encoder(tokenizer_path, max_units).encode
        as_batch = lambda row: pa.RecordBatch.from_pylist([row], schema=target)
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for row in writer.add(doc_id, ids_of(text.as_py()) + end):
                    yield as_batch(row)
        if writer.n:
            yield as_batch(writer.flush())

    ordered = (id_and_text(docs).withColumn("h", F.xxhash64("text"))
               .repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h", "text").drop("h"))
    ordered.mapInArrow(encode, CHUNK_SCHEMA).write.option("compression", "none").parquet(f"{path}/chunks")
    spark = docs.sparkSession
    heads = spark.read.schema(CHUNK_SCHEMA).parquet(f"{path}/chunks").select(
        "shard", "chunk", "first_id", "n_ids", "plane_bytes")
    # one row per shard: the running total over shards is over a table of that size only
    base = (heads.groupBy("shard").agg(F.sum("n_ids").alias("ids"))
            .select("shard", (F.sum("ids").over(Window.orderBy("shard")) - F.col("ids")).alias("base")))
    (heads.join(base, "shard").select("shard", "chunk", (F.col("base") + F.col("first_id")).alias("start"),
                                      "n_ids", "plane_bytes")
     .write.parquet(f"{path}/index"))


# CRC-32 as in zlib: reflected polynomial, and the operator that appends zero bytes.
_POLY = 0xEDB88320


def _times(a: int, b: int) -> int:
    """a * b modulo the CRC polynomial (bit 31 is the constant term)."""
    product, bit = 0, 1 << 31
    while bit:
        if a & bit:
            product ^= b
        b = (b >> 1) ^ _POLY if b & 1 else b >> 1
        bit >>= 1
    return product


def crc32_join(crc_a: int, crc_b: int, bytes_b: int) -> int:
    """CRC-32 of two byte strings in a row, from the CRC of each and the second's length."""
    shift, square, n = 1 << 31, 1 << 23, bytes_b      # x^0; x^8, one byte
    while n:
        if n & 1:
            shift = _times(shift, square)
        square = _times(square, square)
        n >>= 1
    return _times(shift, crc_a) ^ crc_b


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, piece_start, n_ids, ids) for every part of a document in a chunk."""
    def decode(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {"doc_id": [], "shard": [], "doc_no": [], "start": [], "ids": []}
        for r in batch.to_pylist():
            ids, at = unpack_chunk(r["payload"], r["plane_bytes"], r["n_ids"], r["bits"]), 0
            for k, (doc_id, stop) in enumerate(zip(r["doc_ids"], r["doc_ends"], strict=True)):
                out["doc_id"].append(doc_id)
                out["shard"].append(r["shard"])
                out["doc_no"].append(r["first_doc"] + k)
                out["start"].append(r["start"] + at)
                out["ids"].append(ids[at:stop])
                at = stop
        return out

    return map_batches(_chunks(spark, path), decode,
                       "doc_id long, shard int, doc_no long, start long, ids array<long>")


def _chunks(spark: SparkSession, path: str) -> DataFrame:
    chunks = spark.read.schema(CHUNK_SCHEMA).parquet(f"{path}/chunks")
    index = spark.read.parquet(f"{path}/index")
    base = index.where("chunk = 0").select("shard", F.col("start").alias("base"))
    return chunks.join(base, "shard").withColumn("start", F.col("base") + F.col("first_id")).drop("base")


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, decoded from the files.

    Chunks are decoded independently; only the parts of documents that span chunks
    meet again (three numbers each), and their CRCs are joined arithmetically.
    """
    def digest(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {k: [] for k in ("doc_id", "shard", "doc_no", "start", "n_tokens", "crc", "whole")}
        for r in batch.to_pylist():
            ids = unpack_chunk(r["payload"], r["plane_bytes"], r["n_ids"], r["bits"])
            raw, at, last = ids.tobytes(), 0, len(r["doc_ids"]) - 1
            for k, (doc_id, stop) in enumerate(zip(r["doc_ids"], r["doc_ends"], strict=True)):
                out["doc_id"].append(doc_id)
                out["shard"].append(r["shard"])
                out["doc_no"].append(r["first_doc"] + k)
                out["start"].append(r["start"] + at)
                out["n_tokens"].append(stop - at)
                out["crc"].append(zlib.crc32(raw[4 * at:4 * stop]))
                # the first and the last of a chunk may go on in its neighbours
                out["whole"].append(0 < k < last)
                at = stop
        return out

    pieces = map_batches(_chunks(spark, path), digest, "doc_id long, shard int, doc_no long, start long, "
                                                       "n_tokens long, crc long, whole boolean")
    join_crc = F.udf(_join_pieces, "long")
    digests = ["doc_id", "start", "n_tokens", F.col("crc").alias("ids_crc32")]
    # one pass over the chunks: both branches read the written pieces
    from kbforge.llm.common import save

    pieces = save(pieces, "pieces")
    edge = (pieces.where("not whole").groupBy("shard", "doc_no")
            .agg(F.first("doc_id").alias("doc_id"), F.min("start").alias("start"),
                 F.sum("n_tokens").alias("n_tokens"),
                 F.sort_array(F.collect_list(F.struct("start", "n_tokens", "crc"))).alias("parts"))
            .withColumn("crc", F.when(F.size("parts") == 1, F.col("parts")[0]["crc"])
                        .otherwise(join_crc("parts"))))
    return pieces.where("whole").select(*digests).unionByName(edge.select(*digests))


def _join_pieces(parts) -> int:
    crc = 0
    for p in parts:
        crc = crc32_join(crc, p["crc"], 4 * p["n_tokens"])
    return crc
