import base64
import hashlib
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from conftest_llm import EDGE_TEXTS
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from duewise.llm import byte_bpe, token_files


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.just(0), st.integers(0, 3), st.integers(0, 50_000), st.integers(0, 2**64 - 1)), max_size=3000))
def test_pack_round_trip(values):
    x = np.array(values, np.uint64)
    words, offsets, escapes = token_files.pack(x)
    assert token_files.unpack(words, offsets, escapes, len(x)).tolist() == values


def test_pack_is_compact():
    assert len(token_files.pack(np.zeros(1200, np.uint64))[0]) <= 12
    assert len(token_files.pack(np.full(1024, 7, np.uint64))[0]) == -(-1024 // 20)


def brute_op1(texts):
    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    start, out = 0, []
    for i, text in enumerate(texts):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_op1(spark, folder):
    texts = [*EDGE_TEXTS, *(f"document {i} <|endoftext|> it's {i * 7}" for i in range(40))]
    rows = token_files.op1(spark, folder(texts)).orderBy("doc_id").collect()
    assert [tuple(r) for r in rows] == brute_op1(texts)


def test_op1_empty(spark, folder):
    assert token_files.op1(spark, folder([])).count() == 0


def test_null_ids_and_escapes_survive_the_file(spark, tmp_path):
    df = spark.createDataFrame([(None, [1, 2]), (5, []), (5, [2**61, 3])], "doc_id long, ids array<long>").coalesce(1)
    token_files.write_token_files(df, f"{tmp_path}/t")
    got = token_files.read_token_files(spark, f"{tmp_path}/t").orderBy("place", "n_tokens").collect()
    assert [(r.doc_id, r.place, r.ids) for r in got] == [(None, 0, [1, 2]), (5, 2, []), (5, 2, [2**61, 3])]


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def own():
    return byte_bpe.ByteBpe(*byte_bpe.public_vocabulary())


def same(own, reference, text):
    coded = own.encode(text)
    assert np.frombuffer(coded, "<u4").tolist() == reference.encode_ordinary(text)
    assert own.decode(np.frombuffer(coded, "<u4")) == text.encode()


def test_every_piece_and_every_character(own, reference):
    for piece in own.pieces:
        try:
            same(own, reference, piece.decode())
        except UnicodeDecodeError:
            pass
    for lo in range(0, 0x11000, 64):
        text = "".join(f"a{chr(c)}b{chr(c)}{chr(c)} 1{chr(c)}2" for c in range(lo, lo + 64) if not 0xD800 <= c < 0xE000)
        same(own, reference, text)


@settings(max_examples=200, deadline=None)
@given(st.text(st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(" \n\t'sdltrevm  ")), max_size=60))
def test_like_the_rank_library(own, reference, text):
    same(own, reference, text)


def test_op3(spark, folder, reference):
    rows = byte_bpe.op3(spark, folder(EDGE_TEXTS)).orderBy("doc_id").collect()
    for r, text in zip(rows, EDGE_TEXTS, strict=True):
        ids = reference.encode_ordinary(text or "")
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()


def test_bpe_keeps_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a b", "kept", "gone")], "doc_id long, text string, decoded_ids string, ids string")
    got = byte_bpe.bpe_encode(df, *byte_bpe.public_vocabulary()).collect()[0]
    assert got.decoded_ids == "kept" and got.ids and isinstance(got.ids[0], int)


def test_small_cache_and_parts_give_the_same_ids(monkeypatch, reference):
    monkeypatch.setattr(byte_bpe.ByteBpe, "KEEP_BYTES", 500)
    monkeypatch.setattr(byte_bpe.ByteBpe, "BLOCK_UNITS", 3)
    coder = byte_bpe.ByteBpe(*byte_bpe.public_vocabulary())
    for text in [t or "" for t in EDGE_TEXTS] + [" ".join(f"word{i} and {i}" for i in range(500))]:
        ids = np.frombuffer(coder.encode(text), "<u4")
        assert ids.tolist() == reference.encode_ordinary(text) and coder.decode(ids) == text.encode()


def test_round_trip_keeps_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a b", "x", 5), (1, "a b", "x", 5), (None, None, None, None)], "doc_id long, text string, part string, ids int")
    got = byte_bpe.bpe_round_trip(df, *byte_bpe.public_vocabulary(), ids="token_ids")
    assert got.columns == ["doc_id", "part", "ids", "n_tokens", "ids_sha256", "decoded_sha256", "token_ids"]
    assert sorted((r.part or "", r.ids or 0, r.n_tokens, len(r.token_ids)) for r in got.collect()) == [("", 0, 0, 0), ("x", 5, 2, 2), ("x", 5, 2, 2)]
