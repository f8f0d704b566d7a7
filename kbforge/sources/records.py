"""Splittable reading of CSV records whose quoted fields may hold newlines.

A file is scanned by byte ranges as lines.  Where a range begins is unknown to the
task that reads it: at the start of a record, or inside a quoted field that an
earlier range opened.  So a first pass reads every range under both assumptions and
keeps, per range, which of the two each one ends in, and the line parts that are cut
off at its two edges.  One row per range then tells, range by range, which assumption
holds, and the cut parts are joined to the records that span ranges.  The second
pass gives the records that lie within a range, each task starting in the state that
is now known.

Records are text; the fields are parsed by Spark's own CSV parser afterwards.  A field
is quoted only if a quote is its first character; a doubled quote stays inside, and
what follows a closing quote up to the next comma belongs to the field, as that parser
has it.  Files whose first line ends with carriage return and newline have those line
ends; the carriage returns before newlines do not belong to their records.  A quoted
field that a file never closes ends without the file's last newline.

Needs an encoding in which the bytes of a newline, a quote and a comma stand for
nothing else (UTF-8, Latin-1 and other one-byte encodings of ASCII).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import broadcast_limit, checkpoint_dir, run_folder, ship_package

# Encodings that are read by ranges (lower case, without separators).
ASCII_BASED = {"utf8", "usascii", "ascii", "latin1", "iso88591", "iso885915", "windows1252", "cp1252"}
EDGE_CHARS = 1 << 20        # a cut part longer than this is read again instead of being kept

_FIELD = r'(?:"(?:[^"]++|"")*+"[^,]*+|[^",][^,]*+|)'
_CLOSED = re.compile(rf"{_FIELD}(?:,{_FIELD})*+", re.DOTALL)
_CLOSES = re.compile(rf'(?:[^"]++|"")*+"[^,]*+(?:,{_FIELD})*+', re.DOTALL)

PART = "file string, owner long, start long, header boolean, text string"
EDGES = ("file string, start long, crlf boolean, ends_0 int, ends_1 int, head_done boolean, head string, "
         "tail_0 string, tail_1 string, closed boolean, long boolean")


def _schema(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def is_splittable(encoding: str) -> bool:
    return re.sub("[-_ ]", "", encoding).lower() in ASCII_BASED


def after_line(line: str, inside: int) -> int:
    """Whether a quoted field is open (1) after ``line``, if one was (``inside``) before it."""
    if '"' not in line:
        return inside
    return int((_CLOSES if inside else _CLOSED).fullmatch(line) is None)


def lines(spark: SparkSession, path: str, encoding: str) -> DataFrame:
    """(file, start, line) of all files, the lines of a byte range in order."""
    raw = spark.read.option("lineSep", "\n").text(path)
    return raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
                      F.decode(F.col("value").cast("binary"), encoding).alias("line"))


class _Open:
    """A record that is being read: its lines, or only that they are too long to keep."""

    def __init__(self):
        self.lines: list[str] | None = []
        self.size = 0

    def add(self, line: str) -> None:
        self.size += len(line) + 1
        if self.size > EDGE_CHARS:
            self.lines = None
        elif self.lines is not None:
            self.lines.append(line)

    def text(self) -> str | None:
        return None if self.lines is None else "\n".join(self.lines)


class _Range:
    """One byte range read under both assumptions."""

    def __init__(self, file: str, start: int):
        self.file, self.start, self.crlf, self.closed = file, start, None, False
        self.state = [0, 1]
        self.open = [None, _Open()]         # the record open at this place, by assumption
        self.head, self.head_done = self.open[1], False

    def add(self, line: str) -> None:
        if self.crlf is None:
            self.crlf = line.endswith("\r")
        after = [after_line(line, s) for s in (0, 1)] if '"' in line else [0, 1]
        for k in (0, 1):
            if self.open[k] is not None:
                self.open[k].add(line)
            elif after[self.state[k]]:
                self.open[k] = _Open()
                self.open[k].add(line)
            self.state[k] = after[self.state[k]]
            if not self.state[k]:
                self.closed |= k == 0
                if self.open[k] is self.head:
                    self.head_done = True
                self.open[k] = None

    def row(self) -> dict:
        parts = [self.head, *(o for o in self.open if o is not None and o is not self.head)]
        tails = [None if o is None or o is self.head else o.text() for o in self.open]
        return {"file": self.file, "start": self.start, "crlf": self.crlf, "ends_0": self.state[0],
                "ends_1": self.state[1], "head_done": self.head_done, "head": self.head.text(), "tail_0": tails[0],
                "tail_1": tails[1], "closed": self.closed, "long": any(o.lines is None for o in parts)}


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, list[str]]]:
    """(file, start, lines) in order; a range comes in one piece or several."""
    for batch in batches:
        files, starts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        text, at = batch.column(2).to_pylist(), 0
        for i in range(1, len(text) + 1):
            if i == len(text) or starts[i] != starts[at] or files[i] != files[at]:
                yield files[at], starts[at], text[at:i]
                at = i


def edges(scanned: DataFrame) -> DataFrame:
    """First pass: one row per byte range that has the start of a line."""
    target = _schema(EDGES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        for file, start, text in _ranges(batches):
            if now is None or (now.file, now.start) != (file, start):
                if now is not None:
                    yield pa.RecordBatch.from_pylist([now.row()], schema=target)
                now = _Range(file, start)
            for line in text:
                now.add(line)
        if now is not None:
            yield pa.RecordBatch.from_pylist([now.row()], schema=target)

    return scanned.mapInArrow(run, EDGES)


class _Known:
    """What the first pass tells of one range."""

    def __init__(self, state: int, crlf: bool, owner: int | None):
        self.state, self.crlf, self.owner = state, crlf, owner      # owner: range where the open record began


def _follow(rows: list) -> dict[tuple[str, int], _Known]:
    """State at the start of every range: the ends of the ranges before, applied in order."""
    known: dict[tuple[str, int], _Known] = {}
    file, state, crlf, owner = None, 0, False, None
    for r in sorted(rows, key=lambda r: (r["file"], r["start"])):
        if r["file"] != file:
            file, state, crlf, owner = r["file"], 0, r["crlf"], None
        known[file, r["start"]] = _Known(state, crlf, owner)
        after = r["ends_1"] if state else r["ends_0"]
        if after and (not state or r["head_done"]):
            owner = r["start"]
        state = after
    return known


def _batch(rows: list[tuple], target: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * len(target)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, target, strict=True)], schema=target)


class _Reader:
    """One byte range read in the state that is known: whole records, and the parts cut off at its edges."""

    def __init__(self, file: str, start: int, here: _Known):
        self.file, self.start, self.here = file, start, here
        self.state, self.is_head, self.header = here.state, bool(here.state), start == 0
        self.opened: list[str] = []

    def part(self) -> tuple:
        owner = self.here.owner if self.is_head else self.start
        return self.file, owner, self.start, self.header and not self.is_head, "\n".join(self.opened)

    def read(self, text: list[str]) -> tuple[list[tuple], list[tuple]]:
        """(records, parts) that end in these lines."""
        records, parts = [], []
        for line in text:
            self.state = after_line(line, self.state)
            self.opened.append(line)
            if self.state:
                continue
            if self.is_head:
                parts.append(self.part())
            elif not self.header:
                record = record_text("\n".join(self.opened), self.here.crlf)
                if record:
                    records.append((record,))
            self.header &= self.is_head
            self.opened, self.is_head = [], False
        return records, parts


def _whole(scanned: DataFrame, known: dict, cut_parts: bool) -> DataFrame:
    """Second pass: (record) of the records within ranges, headers left out.

    With ``cut_parts`` instead the parts cut off at range edges, see :func:`_parts`.
    """
    schema = PART if cut_parts else "record string"
    target = _schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = None
        for file, start, text in _ranges(batches):
            if reader is None or (reader.file, reader.start) != (file, start):
                if reader is not None and reader.opened and cut_parts:
                    yield _batch([reader.part()], target)
                reader = _Reader(file, start, known[file, start])
            records, parts = reader.read(text)
            yield _batch(parts if cut_parts else records, target)
        if reader is not None and reader.opened and cut_parts:
            yield _batch([reader.part()], target)

    return scanned.mapInArrow(run, schema)


def _parts(saved: DataFrame, known: dict) -> DataFrame:
    """The parts cut off at range edges, from what the first pass kept."""
    target = _schema(PART)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for r in batch.to_pylist():
                file, start = r["file"], r["start"]
                here = known[file, start]
                if here.state:
                    found.append((file, here.owner, start, False, r["head"]))
                tail = r["tail_1"] if here.state else r["tail_0"]
                if tail is not None:
                    found.append((file, start, start, start == 0 and not r["closed"] and not here.state, tail))
            yield _batch(found, target)

    return saved.mapInArrow(run, PART)


def record_text(text: str, crlf: bool) -> str:
    return text.replace("\r\n", "\n").removesuffix("\r") if crlf else text


def csv_records(spark: SparkSession, path: str, encoding: str) -> DataFrame:
    """(record): every CSV record of the files below ``path`` as text, in no order, without the headers."""
    checkpoint_dir(spark)
    ship_package(spark)
    scanned = lines(spark, path, encoding)
    folder = run_folder(spark, "csv-ranges")
    edges(scanned).write.parquet(folder)
    saved = spark.read.schema(EDGES).parquet(folder)
    # one small row per range; a range is never smaller than spark.sql.files.maxPartitionBytes or its file
    number, names = saved.agg(F.count("*"), F.coalesce(F.sum(F.length("file")), F.lit(0))).first()
    if 100 * number + names > broadcast_limit(spark):
        raise ValueError(f"{number} byte ranges: raise spark.sql.files.maxPartitionBytes or spark.kbforge.broadcast.maxBytes")
    known = _follow(saved.drop("head", "tail_0", "tail_1").collect())
    cut_long = saved.where("long").take(1)
    parts = _whole(scanned, known, cut_parts=True) if cut_long else _parts(saved, known)
    crlf_files = sorted({file for (file, _), k in known.items() if k.crlf})
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "head", "text"))), lambda x: x["text"]), "\n")
    is_crlf = F.col("file").isin(crlf_files) if crlf_files else F.lit(False)
    spanning = (parts.withColumn("head", F.col("owner") == F.col("start"))      # a range's head part precedes its tail
                .groupBy("file", "owner").agg(text.alias("text"), F.bool_or("header").alias("header")).where("not header")
                .select(F.when(is_crlf, F.regexp_replace(F.regexp_replace("text", "\r\n", "\n"), "\r$", ""))
                        .otherwise(F.col("text")).alias("record")).where("record <> ''"))
    return _whole(scanned, known, cut_parts=False).unionByName(spanning)
