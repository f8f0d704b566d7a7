"""Splittable CSV: the same records as the whole-file reader, wherever the byte ranges end."""
import os
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kbforge.sources import records as R
from kbforge.sources.csv import _raw, read_posts_csv, read_tags_csv

SCHEMA = T.StructType([T.StructField("Id", T.LongType()), T.StructField("Score", T.IntegerType()),
                       T.StructField("Title", T.StringType())])
TEXT = T.StructType([T.StructField(c, T.StringType()) for c in ("Id", "Score", "Title", "_corrupt_record")])


@pytest.fixture()
def ranges(spark):
    """Set the size of a byte range for one test."""
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    yield lambda size: spark.conf.set(key, str(size))
    spark.conf.set(key, before)


def whole(spark, path, encoding="UTF-8"):
    return (spark.read.schema(TEXT).options(header="true", multiLine="true", quote='"', escape='"', encoding=encoding,
                                            mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt_record").csv(path))


def rows(df):
    return sorted((tuple(r) for r in df.select("Id", "Score", "Title").collect()), key=str)


def write(folder, data, name="q.csv"):
    path = os.path.join(folder, name)
    with open(path, "wb") as f:
        f.write(data)
    return path


FIELDS = ["", "7", "abc", '""', '"a"', '"a,b"', '"line one\nline two"', '"\n"', '"\n\n,\n"', '"he said ""no"""', '""""', '"""\n"""',
          'in"side', 'end"', "é ÿ", '"é\n"', '"x" y', ' "z"', "'", '"a"b"c']


def made(seed, n, eol="\n"):
    rng = random.Random(seed)
    out = ["Id,Score,Title"]
    for i in range(n):
        out.append(",".join([str(i), *(rng.choice(FIELDS) for _ in range(rng.choice([0, 1, 2, 2, 2, 2, 3])))]))
        if rng.random() < 0.05:
            out.append("")
    return eol.join(x.replace("\n", eol) for x in out) + rng.choice(["", eol])


@pytest.mark.parametrize("eol", ["\n", "\r\n"])
def test_generated_file_in_small_ranges(spark, tmp_dir, ranges, eol):
    path = write(tmp_dir, made(len(eol), 200, eol).encode("utf-8"))
    want = rows(whole(spark, path))
    assert len(want) >= 170
    ranges(1100)
    assert rows(_raw(spark, path, SCHEMA, "UTF-8")) == want


def by_ranges(text, cuts):
    """The records of ``text`` read as byte ranges that begin at the lines ``cuts``, without Spark."""
    lines = text.split("\n")
    if lines and not lines[-1]:
        lines.pop()
    cuts = sorted({0, *(c for c in cuts if c < len(lines))})
    pieces = [lines[a:b] for a, b in zip(cuts, [*cuts[1:], len(lines)], strict=True)]
    first = []
    for start, piece in zip(cuts, pieces, strict=True):
        one = R._Range("f", start)
        for line in piece:
            one.add(line)
        first.append(one.row())
    known = R._follow(first)
    records, parts, kept = [], [], []
    for start, piece, row in zip(cuts, pieces, first, strict=True):
        reader = R._Reader("f", start, known["f", start])
        found, cut = reader.read(piece)
        records += [r for r, in found]
        parts += cut + ([reader.part()] if reader.opened else [])
        here = known["f", start]
        if here.state:
            kept.append(("f", here.owner, start, False, row["head"]))
        tail = row["tail_1"] if here.state else row["tail_0"]
        if tail is not None:
            kept.append(("f", start, start, start == 0 and not row["closed"] and not here.state, tail))
    assert sorted(parts) == sorted(kept)            # what the first pass keeps is what the second would find
    owners = {}
    for _, owner, start, header, piece in sorted(parts, key=lambda p: (p[1], p[1] != p[2], p[2])):
        owners.setdefault(owner, [False, []])
        owners[owner][0] |= header
        owners[owner][1].append(piece)
    records += [R.record_text("\n".join(p), first[0]["crlf"]) for header, p in owners.values() if not header]
    return sorted(r for r in records if r)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(['"', '""', "a", ",", "\n", "\n", '"\n', ',"', "\r\n"]), max_size=40).map("".join),
       st.lists(st.integers(0, 20), max_size=8))
def test_every_cut_gives_the_records_of_the_whole(text, cuts):
    assert by_ranges(text, cuts) == by_ranges(text, [])


def test_one_record_over_many_ranges_and_long_cut_parts(spark, tmp_dir, ranges, monkeypatch):
    body = "\n".join(f'line {i}, ""q""' for i in range(300))
    path = write(tmp_dir, f'Id,Score,"Ti\ntle"\n1,2,"{body}"\n2,3,plain\n3,4,"{body}"'.encode())
    want = rows(whole(spark, path))
    assert len(want) == 3
    ranges(1500)
    for kept in (1 << 20, 10):
        monkeypatch.setattr(R, "EDGE_CHARS", kept)
        assert rows(_raw(spark, path, SCHEMA, "UTF-8")) == want


def test_many_tasks_read_one_file(spark, tmp_dir, ranges):
    path = write(tmp_dir, made(5, 600).encode("utf-8"))
    ranges(1000)
    scanned = R.lines(spark, path, "UTF-8")
    tasks = scanned.select(F.spark_partition_id().alias("p")).distinct().count()
    assert tasks >= 8
    assert R.csv_records(spark, path, "UTF-8").select(F.spark_partition_id().alias("p")).distinct().count() >= 8


def test_folder_of_files_with_other_line_ends_unclosed_quotes_and_gzip(spark, tmp_dir, ranges):
    import gzip
    folder = os.path.join(tmp_dir, "in")
    os.mkdir(folder)
    write(folder, made(1, 50).encode("utf-8"), "a.csv")
    write(folder, made(2, 50, "\r\n").encode("utf-8"), "b.csv")
    write(folder, b'Id,Score,Title\n1,2,"never closed\nto the end', "c.csv")
    write(folder, b"Id,Score,Title\n", "d.csv")
    write(folder, b"", "e.csv")
    write(folder, gzip.compress(made(3, 50).encode("utf-8")), "f.csv.gz")
    want = sum((rows(whole(spark, os.path.join(folder, n))) for n in sorted(os.listdir(folder)) if n != "e.csv"), [])
    ranges(900)
    assert rows(_raw(spark, folder, SCHEMA, "UTF-8")) == sorted(want, key=str)


def test_latin1_and_an_encoding_that_is_read_whole(spark, tmp_dir, ranges):
    ranges(900)
    path = write(tmp_dir, made(9, 160).encode("latin-1"))
    assert rows(_raw(spark, path, SCHEMA, "ISO-8859-1")) == rows(whole(spark, path, "ISO-8859-1"))
    assert R.is_splittable("iso-8859-1") and R.is_splittable("UTF-8") and not R.is_splittable("UTF-16")
    wide = write(tmp_dir, made(9, 60).encode("utf-16"), "wide.csv")
    assert rows(_raw(spark, wide, SCHEMA, "UTF-16")) == rows(whole(spark, wide, "UTF-16"))


def test_strict_reader_fails_on_a_long_row_in_any_range(spark, tmp_dir, ranges):
    ranges(500)
    path = write(tmp_dir, b"Id,Score,Title\n" + b'1,2,"a\nb"\n' * 60 + b'2,2,"a\nb",x\n' + b"3,4,z\n" * 30)
    with pytest.raises(Exception, match="malformed CSV row"):
        read_tags_csv(spark, path, SCHEMA).collect()
    assert read_posts_csv(spark, path, SCHEMA).count() == 90


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(['"', '""', "a", ",", "\n", "\r", " "]), max_size=30).map("".join))
def test_state_of_lines_is_that_of_a_character_automaton(text):
    def automaton(line, inside):
        state = "quoted" if inside else "start"
        i = 0
        while i < len(line):
            c = line[i]
            if state == "quoted":
                if c == '"' and line[i + 1:i + 2] == '"':
                    i += 1
                elif c == '"':
                    state = "after"
            elif c == ",":
                state = "start"
            elif state == "start":
                state = "quoted" if c == '"' else "plain"
            i += 1
        return int(state == "quoted")

    state = 0
    for line in text.split("\n"):
        assert R.after_line(line, state) == automaton(line, state)
        assert R.after_line(line, 1) == automaton(line, 1)
        state = R.after_line(line, state)
