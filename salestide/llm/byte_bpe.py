"""Byte-level BPE encoding with offsets, and decoding.

Ids come from the tokenizers library, built from a file of ranks: each byte is spelled
as one printable character by a fixed table, a pattern splits the text, and inside a
match two neighbours merge if the ranks hold what they make together, lowest rank first.

Texts stay in their Arrow buffers. They are cut where a match ends in any case, each distinct stretch of a batch is encoded once, and the ids of the texts are
put together by number. A token knows its bytes, so its place in the text in bytes is a
running sum, and in characters the number of characters that begin before it. Decoding
takes the bytes of all tokens together before they are read as UTF-8: a character whose
bytes are split over tokens comes out whole, and one that isn't complete is replaced.

Tasks work on whole texts, batch by batch; a bounded table of known stretches lives as
long as the Python worker. Nothing is shuffled.
"""

from __future__ import annotations

import base64
import hashlib
import os
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from salestide.llm.bpe import byte_letters, forget

KNOWN_STRETCHES = 300_000
KNOWN_BYTES = 64
BYTES_AT_ONCE = 4_000_000


# Kinds of bytes: letters and digits, other visible characters, and what begins
# characters among which there is white space beyond ASCII.
_WORD, _MARK, _WIDE = 1, 2, 4
_KIND = np.zeros(256, np.uint8)
_KIND[0x21:0x7F] = _MARK
_KIND[[b for b in range(0x80) if chr(b).isalnum()]] = _WORD
_KIND[[0xC2, 0xE1, 0xE2, 0xE3]] = _WIDE


def cuts(data: np.ndarray) -> np.ndarray:
    """For each place, and the end: is it one that the pattern never matches across,
    whatever stands around it? Such places are before a blank between two characters
    that aren't white space; before and after a line end of that kind; and between an
    ASCII letter or digit and a mark, but for what follows an apostrophe.

    Characters beyond ASCII are taken for white space if their lead byte is one with
    which some is written, or isn't looked at.
    """
    out = np.zeros(len(data) + 1, bool)
    if len(data) < 4:
        return out
    kind = _KIND[data]
    visible = (kind & (_WORD | _MARK)) > 0
    ends = visible.copy()
    ends[1:] |= (data[1:] >= 0x80) & (data[:-1] >= 0xC3) & (data[:-1] < 0xE0)
    starts = visible | ((data >= 0xC3) & (kind != _WIDE))
    between = ends[:-2] & starts[2:]
    lines = between & (data[1:-1] == 0x0A)
    out[1:-2] = lines | (between & (data[1:-1] == 0x20))
    out[2:-1] |= lines
    out[1:-1] |= visible[:-1] & visible[1:] & (kind[:-1] != kind[1:]) & (data[:-1] != 0x27)
    return out


class ByteEncoder:
    """Texts to ids and back for one file of ranks."""

    def __init__(self, path: str, pattern: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Regex, Tokenizer, models, pre_tokenizers

        with open(path, "rb") as file:
            pairs = [line.split() for line in file]
        ranks = {base64.b64decode(token): int(rank) for token, rank in pairs}
        letters = byte_letters()
        shown = {token: "".join(map(letters.__getitem__, token)) for token in ranks}
        merges = [
            (shown[token[:k]], shown[token[k:]])
            for token in sorted(ranks, key=ranks.__getitem__)
            for k in range(1, len(token))
            if token[:k] in ranks and token[k:] in ranks
        ]
        model = models.BPE({shown[token]: rank for token, rank in ranks.items()}, merges)
        self.library = Tokenizer(model)
        self.library.pre_tokenizer = pre_tokenizers.Sequence(
            [
                pre_tokenizers.Split(Regex(pattern), "isolated"),
                pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False),
            ]
        )
        # The byte table read backwards; numbers that the ranks leave out have no bytes.
        byte_of = {letter: byte for byte, letter in letters.items()}
        spelled = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            spelled[rank] = bytes(map(byte_of.__getitem__, shown[token]))
        self.tokens = pa.array(spelled, pa.large_binary())
        self.sizes = np.fromiter(map(len, spelled), np.int64, len(spelled))
        self._known: dict[bytes, bytes] = {}

    def _ids(self, stretches: list[bytes]) -> list[bytes]:
        known = self._known
        found = list(map(known.get, stretches))
        new = [s for s, ids in zip(stretches, found) if ids is None]
        texts = [s.decode() for s in new]
        coded = self.library.encode_batch_fast(texts, add_special_tokens=False)
        fresh = {s: np.array(e.ids, "<u4").tobytes() for s, e in zip(new, coded)}
        kept = {s: ids for s, ids in fresh.items() if len(s) <= KNOWN_BYTES}
        known.update(kept)
        forget(known, set(kept), KNOWN_STRETCHES)
        return [ids if ids is not None else fresh[s] for s, ids in zip(stretches, found)]

    def encode(self, texts: pa.LargeBinaryArray) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other, and where each text's begin, with the end.
        ``texts`` are valid UTF-8 without nulls."""
        borders = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset :][: len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[borders[0] : borders[-1]]
        borders = borders - borders[0]
        cut = cuts(data)
        cut[borders] = True
        stops = np.flatnonzero(cut)
        stretches = pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), len(stops) - 1, [None, pa.py_buffer(stops), pa.py_buffer(data)]
        ).dictionary_encode()
        coded = self._ids(stretches.dictionary.to_pylist())
        ids = np.frombuffer(b"".join(coded), "<u4")
        sizes = np.fromiter(map(len, coded), np.int64, len(coded)) // 4
        first = np.cumsum(sizes) - sizes
        number = stretches.indices.to_numpy()
        n = sizes[number]
        upto = np.concatenate([[0], np.cumsum(n)])
        flat = ids[np.repeat(first[number] - upto[:-1], n) + np.arange(upto[-1])]
        return flat, upto[np.searchsorted(stops, borders)]

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of the tokens one after the other."""
        taken = self.tokens.take(pa.array(ids.astype(np.int64)))
        return taken.buffers()[2].to_pybytes() if len(ids) and taken.buffers()[2] else b""


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> ByteEncoder:
    """One for each Python worker, file and pattern."""
    return ByteEncoder(path, pattern)


def _as_utf8(texts: pa.Array) -> pa.LargeBinaryArray:
    """Null texts as empty ones; bytes that are no UTF-8 become replacement characters."""
    whole = pc.fill_null(texts.cast(pa.large_binary()), b"")
    try:
        whole.cast(pa.large_string())
    except pa.ArrowInvalid:
        repaired = [t.decode("utf-8", "replace").encode() for t in whole.to_pylist()]
        whole = pa.array(repaired, pa.large_binary())
    return whole


def _portions(texts: pa.LargeBinaryArray) -> Iterator[tuple[int, int]]:
    """Stretches of whole texts, bounded in bytes but for a single text that is longer."""
    upto = np.cumsum(pc.binary_length(texts).to_numpy())
    at = 0
    while at < len(texts):
        before = upto[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(upto, before + BYTES_AT_ONCE, "right")))
        yield at, end
        at = end


def _lists(values: np.ndarray, kind: pa.DataType, borders: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(borders.astype(np.int32)), pa.array(values, kind))


def _offsets(sizes: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First character that each token has a byte of, and the end of the last one."""
    stop = np.cumsum(sizes)
    begins = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])  # characters begun before a byte
    start = begins[stop - sizes + 1] - 1 if len(data) else stop
    return start, begins[stop]


def encoded(
    docs: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids", offsets: str | None = None
) -> DataFrame:
    """``docs`` with the array column ``ids``, and on demand ``offsets``: for each id its
    (start, stop) in the text in characters. Columns of these names are replaced.

    A token inside a character has that character's place. Null and empty texts have
    no ids; bytes that are no UTF-8 count as replacement characters. Rows are
    independent of each other, so repeated rows get equal ids.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = encoder(path, pattern)
        for batch in batches:
            place = batch.schema.names.index(column)
            whole = _as_utf8(batch.column(place))
            others = [c for k, c in enumerate(batch.columns) if k != place]
            for a, b in _portions(whole):
                part = whole.slice(a, b - a)
                flat, upto = work.encode(part)
                out = [c.slice(a, b - a) for c in others] + [_lists(flat.view(np.int32), pa.int32(), upto)]
                if offsets:
                    places = [
                        np.stack(_offsets(work.sizes[flat[x:y]], np.frombuffer(t, np.uint8)))
                        for t, x, y in zip(part.to_pylist(), upto[:-1], upto[1:])
                    ]
                    start, stop = np.concatenate(places, axis=1)
                    pairs = pa.StructArray.from_arrays([pa.array(start, pa.int32()), pa.array(stop, pa.int32())], ["start", "stop"])
                    out.append(pa.ListArray.from_arrays(pa.array(upto.astype(np.int32)), pairs))
                yield pa.RecordBatch.from_arrays(out, names)

    column = "_text"
    while column in docs.columns:
        column = "_" + column
    kept = [c for c in docs.columns if c not in (ids, offsets)]
    given = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").cast("binary").alias(column))
    schema = given.drop(column).schema.add(ids, T.ArrayType(T.IntegerType()))
    if offsets:
        span = T.StructType().add("start", T.IntegerType()).add("stop", T.IntegerType())
        schema = schema.add(offsets, T.ArrayType(span))
    names = schema.names
    return given.mapInArrow(run, schema)


def decoded(tokens: DataFrame, path: str, pattern: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``tokens`` with the text of the ids. Null ids spell nothing; a character that the
    ids hold in part only becomes a replacement character."""
    @F.pandas_udf("string")
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        work = encoder(path, pattern)
        for batch in batches:
            rows = (np.asarray([] if i is None else i, np.int64) for i in batch)
            yield pd.Series([work.decode(r).decode("utf-8", "replace") for r in rows], dtype=object)

    return tokens.withColumn(text, decode(F.col(f"`{ids}`")))


def round_trip(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encodes and decodes in one task, so that neither ids nor texts travel.

    One row for each row of ``docs``: key, ``n_tokens``, ``ids_sha256`` (ids as
    little-endian unsigned 32-bit integers) and ``decoded_sha256`` (the decoded bytes).
    Null texts count as empty, null keys stay null, and an empty table gives no rows.
    """

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = encoder(path, pattern)
        sha: Callable[[memoryview], str] = lambda data: hashlib.sha256(data).hexdigest()
        for batch in batches:
            whole = _as_utf8(batch.column(1))
            for a, b in _portions(whole):
                flat, upto = work.encode(whole.slice(a, b - a))
                spelled = memoryview(work.decode(flat))
                at = np.concatenate([[0], np.cumsum(work.sizes[flat])])[upto].tolist()
                raw, ends = memoryview(flat.astype("<u4").tobytes()), (4 * upto).tolist()
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a),
                        pa.array(np.diff(upto), pa.int64()),
                        pa.array([sha(raw[x:y]) for x, y in zip(ends, ends[1:])], pa.string()),
                        pa.array([sha(spelled[x:y]) for x, y in zip(at, at[1:])], pa.string()),
                    ],
                    names,
                )

    given = docs.select(F.col(f"`{key}`"), F.col(f"`{text}`").cast("binary").alias("_text"))
    kind = docs.schema[key].dataType.simpleString()
    names = [key, "n_tokens", "ids_sha256", "decoded_sha256"]
    return given.mapInArrow(digest, f"`{key}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
