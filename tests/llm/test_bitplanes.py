import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from kbforge.llm import bitplanes as B
from kbforge.llm.common import scratch

PATH = public_tokenizers.path("byte_bpe_50k.json")


def library():
    return Tokenizer.from_file(PATH)


def expected(rows):
    t, start, out = library(), 0, []
    for doc_id, text in rows:
        ids = np.array(t.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        out.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


@pytest.mark.parametrize("bits", [False, True])
@pytest.mark.parametrize("n", [0, 1, 7, 8, 1000])
def test_planes_round_trip(bits, n):
    ids = np.random.default_rng(n).integers(0, 2**32, n, dtype=np.uint32)
    sizes, payload = B.pack_chunk(ids, bits, 3)
    assert len(sizes) == (32 if bits else 4) and sum(sizes) == len(payload)
    assert (B.unpack_chunk(payload, sizes, n, bits) == ids).all()


@given(st.binary(max_size=40), st.binary(max_size=300))
def test_crc_of_two_parts(a, b):
    assert B.crc32_join(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", "bc", " ", "  ", "\n", "\t", ".", "'s", "'", "é", "1", "###", "'ll", "中",
                                 "<|endoftext|>", "\x1c", "\xa0", "ñ́", "ʼ", "ɐ", "²", "ǆ"]), max_size=12))
def test_units_encode_as_the_library(parts):
    text = "".join(parts)
    got = np.frombuffer(B.encoder(PATH).encode(text), "<u4").tolist()
    assert got == library_once().encode(text, add_special_tokens=False).ids


_LIBRARY = []


def library_once():
    if not _LIBRARY:
        _LIBRARY.append(library())
    return _LIBRARY[0]


@pytest.mark.parametrize("text", ["<|endoftext|> a", "a  <|endoftext|>  b c", "x<|endoftext|>", "<|endoftext", "a <|endoftext|>"])
def test_special_tokens_as_the_library_has_them(text):
    got = np.frombuffer(B.encoder(PATH).encode(text), "<u4").tolist()
    assert got == library_once().encode(text, add_special_tokens=False).ids


def test_pieces_of_plain_units_are_the_librarys():
    marks = "".join(chr(c) for c in range(0x21, 0x7F) if not chr(c).isalnum())
    letters = [chr(c) for c in range(0x250) if chr(c).isalpha()]
    for text in [" ".join(letters), " ".join(a + b for a, b in zip(letters, letters[7:], strict=False)),
                 " ".join(f"a{m}" for m in marks), " ".join(f"é{m}{k}" for m in marks for k in marks),
                 " ".join(f"{m}s{k}'s{m}{k}'ll7x" for m in marks for k in marks), "x\n\ny \nz w\n v\n"]:
        assert np.frombuffer(B.encoder(PATH).encode(text), "<u4").tolist() == library_once().encode(text).ids


@settings(max_examples=500, deadline=None)
@given(st.text(st.sampled_from("aZé7'sltdre .,-|\n\t\x1f\x85\xa0²ªµß×÷ɏɐ中\U0001f600"), max_size=30))
def test_any_text_encodes_as_the_library(text):
    got = np.frombuffer(B.UnitEncoder.encode(B.encoder(PATH), text), "<u4").tolist()
    assert got == library_once().encode(text, add_special_tokens=False).ids


def test_bounded_dictionaries_do_not_change_ids():
    small = B.UnitEncoder(PATH, max_units=3)
    for text in ["red green blue", "green blue, red. red", "x y z w red", "red green"] * 3:
        assert np.frombuffer(small.encode(text), "<u4").tolist() == library_once().encode(text).ids


@pytest.mark.parametrize("chunk_ids,bits", [(B.CHUNK_IDS, False), (100, True)])
def test_files_round_trip_with_edge_rows(spark, edge_docs, chunk_ids, bits):
    path = scratch(spark, "t")
    B.write_ids(edge_docs, path, PATH, bits=bits, chunk_ids=chunk_ids)
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in B.read_digests(spark, path).collect())
    rows = [(r.doc_id, r.text) for r in edge_docs.collect()]
    want = sorted((r.doc_id is not None, r.doc_id or 0) for r in edge_docs.collect())
    assert [(d is not None, d or 0) for _, d, _, _ in got] == want             # ascending ids, nulls first
    assert [g[0] for g in got] == np.concatenate([[0], np.cumsum([g[2] for g in got])[:-1]]).tolist()
    single = {(d, n, c) for d, _, n, c in expected(rows)}
    assert sorted((str(d), n, c) for _, d, n, c in got) == sorted((str(d), n, c) for d, _, n, c in expected(rows))
    assert {(d, n, c) for _, d, n, c in got} == single
    index = spark.read.parquet(f"{path}/index").collect()
    assert sum(r.n_ids for r in index) == sum(g[2] for g in got) and all(r.n_ids <= chunk_ids for r in index)
    # the ids themselves, put together from the parts
    parts = sorted((r.start, r.doc_id, r.ids) for r in B.read_ids(spark, path).collect())
    stream = [i for p in parts for i in p[2]]
    assert len(stream) == sum(g[2] for g in got)
    for start, _doc, n, crc in got:
        assert zlib.crc32(np.array(stream[start:start + n], "<u4").tobytes()) == crc


def test_empty_table(spark, no_docs):
    path = scratch(spark, "t")
    B.write_ids(no_docs, path, PATH)
    assert B.read_digests(spark, path).collect() == []
