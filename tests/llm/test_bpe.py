"""The trie encoder against the tokenizers library, exactly."""

from __future__ import annotations

import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from salestide.llm import bpe, token_files
from salestide.llm.queries import vocabulary


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(vocabulary())
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def ids_by_library(library, text):
    return library.encode(text, add_special_tokens=False).ids


def both(text):
    ours = bpe.encoder(vocabulary()).encode([text])[0].tolist()
    return ours, token_files._encoder(vocabulary(), "<u2").encode([text])[0].tolist()


pieces = st.one_of(
    st.text(st.characters(exclude_categories=("Cs",)), max_size=30),
    st.text(alphabet="ab1 \u1c89\u1c8a\ua7da\ua7cb\U00010d50\U00010d70\U000105d2\u0307", max_size=12),
    st.text(alphabet="abcdefghijklmnopqrstuvwxyz'.,!?- ", max_size=60),
    st.text(alphabet="aABbΣσİıßéÀ́̇\x1c\x85  \n#", max_size=30),
    st.sampled_from(["<|endoftext|>", "<|startoftext|>", "<|", "|>", "don't", "we'll", "'s", "1234567890"]),
)


@settings(max_examples=400, deadline=None)
@given(st.lists(pieces, max_size=5).map("".join))
def test_same_ids_as_the_library(text):
    library = Tokenizer.from_file(vocabulary())
    expected = ids_by_library(library, text)
    assert both(text) == (expected, expected)


def test_same_ids_for_every_character(library):
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for at in range(0, len(points), 4096):
        text = " ".join(f"ab{chr(c)}cd {chr(c)}1{chr(c)}." for c in points[at : at + 4096])
        expected = ids_by_library(library, text)
        assert both(text) == (expected, expected)


def test_documents(spark, sample, library):
    found = bpe.round_trip(sample, vocabulary(), keep_ids=True).collect()
    texts = {r["doc_id"]: r["text"] for r in sample.collect()}
    assert len(found) == len(texts)
    for r in found:
        ids = ids_by_library(library, texts[r["doc_id"]])
        assert r["ids"] == ids and r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        shown = library.decode(ids, skip_special_tokens=False)
        assert r["decoded_sha256"] == hashlib.sha256(shown.encode()).hexdigest()


def test_awkward_rows(awkward, nothing, library):
    found = bpe.decoded(bpe.encoded(awkward, vocabulary()), vocabulary()).collect()
    assert len(found) == awkward.count()
    for r in found:
        ids = ids_by_library(library, r["text"] or "")
        assert r["ids"] == ids and r["decoded"] == library.decode(ids, skip_special_tokens=False)
    assert bpe.round_trip(nothing, vocabulary()).count() == 0


def test_full_tables_change_nothing(monkeypatch, sample, library):
    monkeypatch.setattr(bpe, "KNOWN_PIECES", 20)
    monkeypatch.setattr(bpe, "KNOWN_WORDS", 10)
    encoder = bpe.Encoder(vocabulary())
    for r in sample.limit(20).collect():
        assert encoder.encode([r["text"]])[0].tolist() == ids_by_library(library, r["text"])
    assert len(encoder._pieces) <= 20
