"""Operator 11 against the tiktoken library."""

import base64
import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortloom.llm import byte_pairs, queries

public_tokenizers = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")

PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
SCHEMA = "doc_id long, text string, ids string, start string, KEY string"
TEXTS = [
    None, "", " ", "a", "don't we'll I'm 's 't", "'" * 90, "'s" * 60, "x" * 333, " " * 257, "\n" * 64 + "end", "a \n\n b" * 30, "12345678901234567890" * 9,
    "naïve café ÀÉ 中文字符。日本語のテキスト、です。" * 12, "\U0001f600\U0001f468‍\U0001f469‍\U0001f467" * 20, "é" * 70, "tab\tand\x1cfile\x85next nbsp　wide" * 9,
    "՘\U000323b0x ՘" * 40, "<|endoftext|> is text", "a" * 100 + " " * 100 + "1" * 100 + "!" * 100, "word " * 200,
]


@pytest.fixture(scope="module")
def library():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def table(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "x", "y", "z") for i, t in zip(ids, texts)], SCHEMA)


def numbers(data):
    return np.frombuffer(data, "<u4").tolist()


@pytest.mark.parametrize(("chunk", "overlap"), [(65_536, 1_024), (64, 24), (16, 8), (7, 3), (5, 1)])
def test_ids_equal_the_library_however_texts_are_cut(spark, library, chunk, overlap):
    rng = np.random.default_rng(chunk)
    alphabet = list("ab1' \n.,é中") + ["'re", "  ", "\r\n", "don't"]
    texts = TEXTS + ["".join(rng.choice(alphabet, rng.integers(1, 400))) for _ in range(60)]
    rows = byte_pairs.decode(byte_pairs.encode(table(spark, texts), PATH, PATTERN, chunk, overlap), PATH, PATTERN).collect()
    assert sorted(r.doc_id for r in rows) == list(range(len(texts)))
    for r in rows:
        text = texts[r.doc_id] or ""
        assert numbers(r.ids) == library.encode_ordinary(text), text[:80]
        assert bytes(r.decoded) == text.encode() == library.decode_bytes(numbers(r.ids))


def test_neighbours_that_do_not_resynchronise_become_one(spark, library, tmp_path):
    text = "short words here " + "x" * 500 + " and " + "y" * 90 + " more words at the end " * 5
    chunks = byte_pairs._chunks(spark.createDataFrame([(1, text)], "doc_id long, text string"), 40, 10)
    merged, places = byte_pairs._stitched(chunks, f"file://{tmp_path}", PATH, PATTERN, 10)
    assert 1 < merged.count() < chunks.count()
    assert max(r[0] for r in merged.select(F.length("text")).collect()) > 500
    rows = {r.start: r for r in places.collect()}
    assert "".join(r.text[rows[r.start].entry - r.start : None if rows[r.start].cut is None else rows[r.start].cut - r.start] for r in merged.orderBy("start").collect()) == text


def test_pieces_of_one_text_are_dealt_as_rows(spark):
    chunks = byte_pairs._chunks(spark.createDataFrame([(1, "word " * 40_000)], "doc_id long, text string"), byte_pairs.CHUNK, byte_pairs.OVERLAP)
    assert [r.start for r in chunks.orderBy("start").collect()] == [0, 65_536, 131_072, 196_608]
    assert max(r[0] for r in chunks.select(F.length("text")).collect()) == byte_pairs.CHUNK + byte_pairs.OVERLAP


def test_classes_are_the_library_s_where_they_are_used():
    """Of characters that have a class here: the library's letters, digits and white space are the same."""
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF]
    kinds = {c: byte_pairs._class(c) for c in every}
    for pattern, kind in ((r"\p{L}", "L"), (r"\p{N}", "N"), (r"\s", "S")):
        only = tiktoken.Encoding("bytes", pat_str=pattern, mergeable_ranks={bytes([k]): k for k in range(256)}, special_tokens={})
        theirs = set(bytes(only.encode_ordinary("".join(every))).decode())
        assert {c for c in theirs if kinds[c]} == {c for c in every if kinds[c] == kind}


def test_rows_without_id_repeats_and_empty_tables(spark, library):
    long = "some words that go on " * 20
    df = table(spark, [long, long, "b", "b", None], [None, 5, 5, 5, None])
    got = byte_pairs.encode(df, PATH, PATTERN, 50, 10).collect()
    want = sorted([(None, long), (5, long), (5, "b"), (5, "b"), (None, "")], key=str)
    assert sorted(((r.doc_id, library.decode(numbers(r.ids))) for r in got), key=str) == want
    assert byte_pairs.decode(byte_pairs.encode(table(spark, []), PATH, PATTERN), PATH, PATTERN).count() == 0
    with pytest.raises((IndexError, ValueError)):
        byte_pairs.codec(PATH, PATTERN).decode(np.array([60_000], "<u4"))


def test_query(spark, library):
    folder = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = queries.op11_byte_pairs(spark, folder).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = np.array(library.encode_ordinary(texts[r.doc_id]), "<u4")
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(texts[r.doc_id].encode()).hexdigest())
