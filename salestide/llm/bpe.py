"""BPE encoding by a prefix-sharing trie, and decoding.

The distinct words of a batch are put in order, which is the order of a depth-first
walk over their trie: each word starts from the prefix it shares with the one before.
At each node one thing is stored, the last token of the prefix's encoding. It is the
one token that ends the prefix and goes together with the last token of what stands
before it; whether two tokens go together follows from undoing their merges. A word's
ids are read backwards along the stored tokens, so a prefix that thousands of words
share is encoded once.

Tasks work on whole texts, batch by batch. A bounded table of known words lives as
long as the Python worker; words beyond it are encoded again with their batch.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salestide.llm.word_pieces import ADDED, forget, spelled, words_of_all

KNOWN_PIECES = 300_000
KNOWN_WORDS = 200_000
KNOWN_PAIRS = 200_000
TEXTS_AT_ONCE = 1000
CHARS_AT_ONCE = 4_000_000


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte: printable Latin-1 for itself, the other
    bytes, in order, from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(0x100 + k) for k, b in enumerate(others)}


class Trie:
    """Encoder of single words for one vocabulary file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        self.end = model["end_of_word_suffix"]
        self.ids: dict[str, int] = model["vocab"]
        self.token = {i: t for t, i in self.ids.items()} | {i: t for t, i in ADDED.items()}
        letters = byte_letters()
        self.as_letters = {b: letters[b] for b in range(256)}
        self.halves: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        for pair in model["merges"]:
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            a, b = self.ids[left], self.ids[right]
            whole = self.ids[left + right]
            if self.halves and whole <= self._newest:
                raise ValueError("ids must be in the order of the merges")
            self._newest = whole
            self.halves[whole], self.merged[a, b] = (a, b), whole
        self._known_pairs: dict[tuple[int, int], bool] = {}
        self._inner: dict[str, int] = {}
        self._final: dict[str, int] = {}
        for text, i in self.ids.items():
            if i in self.halves and not self._together(*self.halves[i], i):
                continue  # no text is encoded to this token
            if text.endswith(self.end) and len(text) > len(self.end):
                self._final[text[: -len(self.end)]] = i
            else:
                self._inner[text] = i
        spelled = [*self._inner, *self._final]
        self._starts = {t[:n] for t in spelled for n in range(1, len(t) + 1)}

    def _together(self, a: int, b: int, before: int | None = None) -> bool:
        """Would the encoding keep this border, looking at merges older than ``before``?

        Both tokens are taken apart, the younger first, down to the letters at the
        border; a merge across it that comes earlier than one undone would have won.
        """
        halves, merged = self.halves, self.merged
        limit = before if before is not None else 1 << 60
        while True:
            across = merged.get((a, b))
            if across is not None and across < limit:
                return False
            left_can, right_can = a in halves, b in halves
            if left_can and (a > b or not right_can):
                limit, a = a, halves[a][1]
            elif right_can:
                # The same merge one place to the left would still come first.
                limit, b = b + 1, halves[b][0]
            else:
                return True

    def _fits(self, a: int, b: int) -> bool:
        fits = self._together(a, b)
        if len(self._known_pairs) < KNOWN_PAIRS:
            self._known_pairs[a, b] = fits
        return fits

    def _reach(self, text: str, at: int, before: int) -> int:
        """Length of the longest end of text[:at] that begins some token; at most one
        more than one place before."""
        starts = self._starts
        size = before + 1
        while size and text[at - size : at] not in starts:
            size -= 1
        return size

    def _last(
        self, text: str, at: int, reach: int, table: dict[str, int], states: list[tuple[int, int, int]]
    ) -> tuple[int, int]:
        """The last token of the encoding of text[:at], with its length."""
        known = self._known_pairs
        for size in range(reach, 0, -1):
            token = table.get(text[at - size : at])
            if token is not None:
                if at == size:
                    return token, size
                pair = (states[at - size][0], token)
                fits = known.get(pair)
                if fits or (fits is None and self._fits(*pair)):
                    return token, size
        raise ValueError(f"the vocabulary cannot spell {text[:at]!r}")

    def encode(self, distinct: Iterable[str]) -> dict[str, list[int]]:
        """Ids of each word. The words are walked as a trie, depth first."""
        out: dict[str, list[int]] = {}
        letters = self.as_letters
        spelled = sorted(
            (w if w.isascii() and w.isprintable() else "".join(map(letters.__getitem__, w.encode())), w) for w in distinct
        )
        states: list[tuple[int, int, int]] = [(-1, 0, 0)]  # token, its length, reach
        before = ""
        for text, word in spelled:
            shared, most = 0, min(len(before), len(text) - 1, len(states) - 1)
            while shared < most and before[shared] == text[shared]:
                shared += 1
            del states[shared + 1 :]
            for at in range(shared + 1, len(text)):
                reach = self._reach(text, at, states[at - 1][2])
                states.append((*self._last(text, at, reach, self._inner, states), reach))
            reach = self._reach(text, len(text), states[-1][2])
            token, size = self._last(text, len(text), reach, self._final, states)
            ids, at = [token], len(text) - size
            while at:
                token, size, _ = states[at]
                ids.append(token)
                at -= size
            out[word] = ids[::-1]
            before = text
        return out


class Encoder:
    """Texts to ids and back for one vocabulary file."""

    def __init__(self, path: str) -> None:
        self.trie = Trie(path)
        self._pieces: dict[str, bytes] = {}
        self._words: dict[str, bytes] = {w: np.int32(i).tobytes() for w, i in ADDED.items()}

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text. Tables hold ids as bytes, so a text is one join."""
        return spelled(texts, self._pieces, self._spelled, KNOWN_PIECES, "<i4")

    def _spelled(self, new: set[str]) -> dict[str, bytes]:
        inside = words_of_all(new)
        known = self._words
        unknown = {w for ws in inside.values() for w in ws if w not in known}
        known.update((w, np.array(i, np.int32).tobytes()) for w, i in self.trie.encode(unknown).items())
        out = {p: b"".join([known[w] for w in ws]) for p, ws in inside.items()}
        forget(known, unknown, KNOWN_WORDS)
        return out

    def decode(self, ids: Iterable[int]) -> str:
        """The vocabulary file names no decoder: tokens joined by single spaces."""
        return " ".join(map(self.trie.token.__getitem__, ids))


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One for each Python worker and file."""
    return Encoder(path)


def _portions(texts: Iterable[str | None]) -> Iterator[list[str]]:
    """Whole texts, a bounded number of characters at once beside the longest one."""
    portion: list[str] = []
    chars = 0
    for text in texts:
        text = text or ""
        if portion and (len(portion) >= TEXTS_AT_ONCE or chars + len(text) > CHARS_AT_ONCE):
            yield portion
            portion, chars = [], 0
        portion.append(text)
        chars += len(text)
    if portion:
        yield portion


def encoded(docs: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with the array column ``ids`` added (one of that name is replaced).

    Null texts count as empty and have no ids. Rows keep their place and are
    independent of each other, so repeated rows get equal ids.
    """

    @F.pandas_udf("array<int>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(
                [i for part in _portions(batch) for i in encoder(path).encode(part)], dtype=object
            )

    return docs.withColumn(ids, encode(F.col(text)))


def decoded(tokens: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``tokens`` with the text that the ids spell; null ids spell nothing."""

    @F.pandas_udf("string")
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([encoder(path).decode(i if i is not None else ()) for i in batch], dtype=object)

    return tokens.withColumn(text, decode(F.col(ids)))


def round_trip(
    docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", keep_ids: bool = False
) -> DataFrame:
    """Encodes and decodes in one task, so that ids and decoded texts needn't travel.

    One row for each row of ``docs``: key, ``n_tokens``, ``ids_sha256`` (decimal ids
    joined by a space), ``decoded_sha256`` and, on demand, ``ids``. Null texts count as empty, null keys
    stay null, and an empty table gives no rows.
    """

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        work = encoder(path)
        decimal = {i: str(i) for i in work.trie.token}
        for batch in batches:
            at = 0
            for portion in _portions(batch["_text"]):
                n, ids_sha, text_sha, kept = [], [], [], []
                for array in work.encode(portion):
                    ids = array.tolist()
                    n.append(len(ids))
                    kept.append(array if keep_ids else None)
                    shown = " ".join(map(decimal.__getitem__, ids))
                    ids_sha.append(hashlib.sha256(shown.encode()).hexdigest())
                    text_sha.append(hashlib.sha256(work.decode(ids).encode()).hexdigest())
                out = {"n_tokens": n, "ids_sha256": ids_sha, "decoded_sha256": text_sha}
                if keep_ids:
                    out["ids"] = pd.Series(kept, dtype=object)
                yield pd.DataFrame({key: batch[key].iloc[at : at + len(n)].to_numpy(), **out})
                at += len(n)

    kind = docs.schema[key].dataType.simpleString()
    columns = f"`{key}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return docs.select(key, F.col(text).alias("_text")).mapInPandas(
        digest, columns + (", ids array<int>" if keep_ids else "")
    )
