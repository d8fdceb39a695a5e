"""Texts to the words that a lower-casing word tokenizer sees.

Texts repeat their words, so everything slow is done once for each distinct piece
between white space, not once for each occurrence.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

# The tokenizer's word pattern and added tokens.
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+", regex.V0)
ADDED = {"<|startoftext|>": 49406, "<|endoftext|>": 49407}
ADDED_SPLIT = re.compile("(" + "|".join(map(re.escape, ADDED)) + ")")


@lru_cache(maxsize=1)
def unassigned() -> re.Pattern:
    """Finds characters that Python's Unicode tables don't know. The tokenizers library
    has tables of its own, which may be newer."""
    unknown = [unicodedata.category(chr(c)) == "Cn" for c in range(sys.maxunicode + 1)]
    edges = np.flatnonzero(np.diff(np.concatenate([[0], unknown, [0]])))
    ranges = zip(edges[::2].tolist(), (edges[1::2] - 1).tolist())
    return re.compile("[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in ranges) + "]")


@lru_cache(maxsize=1)
def _library() -> tuple:
    from tokenizers import Regex, normalizers, pre_tokenizers

    plain = normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()])
    return plain, pre_tokenizers.Split(Regex(WORDS.pattern), "removed", invert=True)


def words_by_library(piece: str) -> list[str]:
    """The words of a piece with characters that only the library's tables know."""
    plain, split = _library()
    found: list[str] = []
    for part in ADDED_SPLIT.split(piece):
        if part in ADDED:
            found.append(part)
        elif part:
            found.extend(word for word, _ in split.pre_tokenize_str(plain.normalize_str(part)))
    return found


def normalised(piece: str) -> str:
    """NFC, then lower case character by character (no special final sigma)."""
    if piece.isascii():
        return piece.lower()
    piece = unicodedata.normalize("NFC", piece)
    return piece.lower() if "Σ" not in piece else "".join(c.lower() for c in piece)


def words(piece: str, plain: str | None = None) -> list[str]:
    """Words of a piece without white space; added tokens come as themselves.
    ``plain``: the piece normalised, if that is known."""
    plain = normalised(piece) if plain is None else plain
    if not plain:
        return []
    # Most pieces are letters only, or letters and one mark.
    if plain.isalpha():
        return [plain]
    if plain[-1] in ".,;:!?" and plain[:-1].isalpha():
        return [plain[:-1], plain[-1]]
    if "<|" not in piece:
        return WORDS.findall(plain)
    found: list[str] = []
    for part in ADDED_SPLIT.split(piece):
        found.extend([part] if part in ADDED else WORDS.findall(normalised(part)))
    return found


def words_of_all(distinct: set[str]) -> dict[str, list[str]]:
    """The words of each piece. The pieces are normalised as one text: nothing
    combines across the line ends between them."""
    order = list(distinct)
    together = "\n".join(order)
    plain = normalised(together).split("\n")
    found = dict(zip(order, map(words, order, plain)))
    if not together.isascii() and unassigned().search(together):
        newer = [piece for piece in order if unassigned().search(piece)]
        found.update((piece, words_by_library(piece)) for piece in newer)
    return found


def spelled(
    texts: list[str],
    known: dict[str, bytes],
    spell: Callable[[set[str]], dict[str, bytes]],
    most: int,
    dtype: str,
) -> list[np.ndarray]:
    """The ids of each text. Texts are split at ASCII white space; the distinct pieces
    are looked up, or spelled, and the texts are put together from them by number.

    ``known`` keeps pieces as bytes from call to call, up to ``most``; ``spell`` is
    asked for the others. Other white space stays inside pieces until words() ends it.
    """
    split = pc.ascii_split_whitespace(pa.array(texts, pa.string()))
    coded = split.flatten().dictionary_encode()
    distinct = coded.dictionary.to_pylist()
    number = coded.indices.to_numpy()
    found = list(map(known.get, distinct))
    fresh = spell({p for p, ids in zip(distinct, found) if ids is None})
    found = [ids if ids is not None else fresh[p] for p, ids in zip(distinct, found)]
    if len(known) + len(fresh) <= most:
        known.update(fresh)

    ids = np.frombuffer(b"".join(found), dtype)
    sizes = np.fromiter(map(len, found), np.int64, len(found)) // np.dtype(dtype).itemsize
    first = np.cumsum(sizes) - sizes
    n = sizes[number]
    stop = np.concatenate([[0], np.cumsum(n)])
    flat = ids[np.repeat(first[number] - stop[:-1], n) + np.arange(stop[-1])]
    border = stop[split.offsets.to_numpy()]
    return [flat[a:b] for a, b in zip(border[:-1].tolist(), border[1:].tolist())]


def forget(known: dict, new: set[str], most: int) -> None:
    """Takes newcomers out of a full table again; what came first, and so is common, stays."""
    for key in new if len(known) > most else ():
        del known[key]
