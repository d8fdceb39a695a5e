"""Byte-level BPE against the tiktoken library, and the round trip."""

import base64
import hashlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from salestide.llm import byte_bpe

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def expected():
    with open(PATH, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def own():
    return byte_bpe.encoder(PATH, PATTERN)


def coded(own, texts):
    flat, upto = own.encode(pa.array([t.encode() for t in texts], pa.large_binary()))
    return [flat[a:b].tolist() for a, b in zip(upto, upto[1:])]


PIECES = st.sampled_from(
    [" ", "  ", "\n", "\t", "\u00a0", "\u3000", "\u2003", "\u1680", "\u0085", "\x1c", "a", "'s", "'S", "don't",
     "\u00e9t\u00e9", "\u6f22\u5b57", "\u0416", "7", "\u0663", "!", "...", "<|endoftext|>", "\U0001f600", "e\u0301",
     "\u1c8a", "\ua7da", "the", " the", "ing", "\0", "\u00df", "\u200b", "\u00c2", "\u20ac"]
)


@given(st.lists(st.lists(PIECES, max_size=12).map("".join), max_size=6))
@settings(max_examples=300, deadline=None)
def test_like_tiktoken_on_awkward_pieces(own, expected, texts):
    assert coded(own, texts) == [expected.encode_ordinary(t) for t in texts]


@given(st.lists(st.text(st.characters(exclude_categories=["Cs"]), max_size=30), max_size=5))
@settings(max_examples=300, deadline=None)
def test_like_tiktoken_on_any_text(own, expected, texts):
    assert coded(own, texts) == [expected.encode_ordinary(t) for t in texts]


def test_like_tiktoken_on_every_character(own, expected):
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"a{c} {c}1{c}! {c}" for c in points[k : k + 64]) for k in range(0, len(points), 64 * 16)]
    assert coded(own, texts) == [expected.encode_ordinary(t) for t in texts]


def test_query_columns_equal_tiktoken(awkward, sample, expected):
    for docs in (awkward, sample):
        want = sorted(
            (str(r.doc_id), len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
             hashlib.sha256((r.text or "").encode()).hexdigest())
            for r in docs.collect()
            for ids in [expected.encode_ordinary(r.text or "")]
        )
        got = byte_bpe.round_trip(docs, PATH, PATTERN).collect()
        assert sorted((str(r[0]), *r[1:]) for r in got) == want


def test_offsets_name_the_characters_of_each_token(awkward, own):
    rows = byte_bpe.encoded(awkward, PATH, PATTERN, offsets="places").collect()
    assert len(rows) == awkward.count()
    for r in rows:
        text = r.text or ""
        assert len(r.ids) == len(r.places)
        covered = 0
        for i, (a, b) in zip(r.ids, r.places):
            token = own.tokens[i].as_py()
            assert token in text[a:b].encode() and a <= covered <= b
            covered = b
        assert covered == len(text)


def test_decoding_joins_split_characters(spark, awkward):
    there = byte_bpe.encoded(awkward, PATH, PATTERN)
    back = byte_bpe.decoded(there, PATH, PATTERN).select("text", "decoded").collect()
    assert all((r.text or "") == r.decoded for r in back)
    ids = there.where("doc_id = 9").first().ids
    part = spark.createDataFrame([(ids[:1] + ids[-2:-1],), (None,), ([],)], "ids array<int>")
    shown = [r.decoded for r in byte_bpe.decoded(part, PATH, PATTERN).collect()]
    assert shown[1:] == ["", ""] and "�" in shown[0]


def test_bytes_that_are_no_utf8(spark):
    rows = spark.createDataFrame([(1, bytearray(b"a\xff\xc3b"))], "doc_id long, raw binary")
    text = rows.select("doc_id", F.col("raw").cast("string").alias("text"))
    want = hashlib.sha256("a��b".encode()).hexdigest()
    assert byte_bpe.round_trip(text, PATH, PATTERN).first().decoded_sha256 == want


def test_empty_table_and_clashing_names(nothing, clashing, awkward):
    assert byte_bpe.round_trip(nothing, PATH, PATTERN).count() == 0
    assert byte_bpe.encoded(nothing, PATH, PATTERN).count() == 0
    out = byte_bpe.encoded(clashing, PATH, PATTERN)
    assert sorted(out.columns) == sorted({*clashing.columns, "ids"}) and out.where("_text = 7").count() == awkward.count()
