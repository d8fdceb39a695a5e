"""Periodic runs of words: stretches that repeat themselves three times or more.

A diagonal is a lag: words q apart are compared, and a row of equal pairs of length m
on the diagonal q is a stretch of length m + q with period q. The diagonals are kept
online and sparse: going through the words in order, each word is matched with an
earlier occurrence, which carries on the diagonal that is active for it or begins one;
when a diagonal is not carried on it ends, and if it was long enough its run is emitted.

A frequent word has a great many earlier occurrences, most of which carry nothing. So
occurrences are compared with what stands before them: the last L words, as one name,
for L = 16, 32, 64, ... Runs with period q in (L/2, L] (up to 16 for the first) have
rows of more than L matches, and where the last L words and those q before them are
equal and q is the smallest period, the latest earlier occurrence of the L words lies
exactly q back: a nearer one would give these words, and by Fine and Wilf the whole run,
a smaller period. Thus each word has at most one lag for each L, no run is missed, and
a text of n words costs n log n for each of log n values of L, whatever repeats in it.

Names are exact: equal pairs of names get equal numbers, no hashes. A task works on
whole texts, batch by batch, and nothing is shuffled.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from salestide.llm.byte_bpe import _as_utf8, _portions

#: A run has at least this many words, and this many periods.
LEAST_WORDS = 24
LEAST_PERIODS = 3
#: Every row of matches has this many: 24 - q for q < 8, 2q from there on.
FIRST_BLOCK = 16

Run = tuple[int, int, int]  # start, length, period


def _recurring(keys: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the places ``at`` (rising) with ``keys``: a number for each, equal where the
    keys are; whether its key occurs again; and the place of its latest earlier
    occurrence, or -1."""
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    number = np.zeros(len(at), np.int64)
    number[order[1:]] = np.cumsum(~same)
    earlier = np.full(len(at), -1, np.int64)
    earlier[order[1:][same]] = at[order[:-1][same]]
    again = np.zeros(len(at), bool)
    again[order[1:][same]] = again[order[:-1][same]] = True
    return number, again, earlier


def _diagonals(at: np.ndarray, lags: np.ndarray, block: int) -> Iterator[tuple[int, Run]]:
    """Goes through the places that have an earlier occurrence, in order. A place next
    to the one before, with the same lag, carries the diagonal on; anything else ends
    it. Yields (first place, run) for every diagonal that ends long enough."""
    active, began, last = 0, 0, -2
    for place, lag in zip(at.tolist() + [-9], lags.tolist() + [0]):
        if lag == active and place == last + 1:
            last = place
            continue
        if active:
            # The L words at the first place match as well, and so do those q before.
            start = began - block + 1 - active
            length = last + 1 - start
            if length >= max(LEAST_WORDS, LEAST_PERIODS * active):
                yield start, (start, length, active)
        active, began, last = lag, place, place


def found_runs(words: np.ndarray, borders: np.ndarray) -> list[list[Run]]:
    """The maximal runs of each text, by start, then period. ``words`` are the numbers
    of the words of all texts one after the other; ``borders`` where texts begin, with
    the end. Equal words have equal numbers."""
    n = len(words)
    out: list[list[Run]] = [[] for _ in borders[1:]]
    text = np.repeat(np.arange(len(borders) - 1), np.diff(borders))
    begin = np.repeat(borders[:-1], np.diff(borders))
    # names[i]: number of the `block` words that end at i within i's text, or -1 if
    # they occur there once only. The text's number goes in with the first.
    block, at = 1, np.arange(n)
    names = np.full(n, -1, np.int64)
    pairs = text * (int(words.max()) + 1 if n else 1) + words
    while len(at):
        number, again, earlier = _recurring(pairs, at)
        names[:] = -1
        names[at[again]] = number[again]
        if block >= FIRST_BLOCK:
            lag = at - earlier
            fit = (earlier >= 0) & (lag <= block) & ((lag > block // 2) | (block == FIRST_BLOCK))
            for start, (_, length, period) in _diagonals(at[fit], lag[fit], block):
                k = int(text[start])
                out[k].append((start - int(borders[k]), length, period))
        at = at[again]
        at = at[at - begin[at] >= 2 * block - 1]  # twice as many words still fit in
        at = at[names[at - block] >= 0]
        pairs = names[at - block] * (n + 1) + names[at]
        block *= 2
    for runs in out:
        runs.sort(key=lambda run: (run[0], run[2]))
    return out


def repeated_words(runs: list[Run], n: int) -> np.ndarray:
    """Which of n words stand in a run after its first period."""
    change = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return np.cumsum(change)[:n] > 0


def strongest(runs: list[Run]) -> Run | None:
    """The run with the most periods; ties: the smallest start, then period."""
    best = None
    for run in runs:
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def _words(texts: pa.LargeBinaryArray) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts one after the other, and where each text's begin."""
    split = pc.ascii_split_whitespace(texts.cast(pa.large_string()))
    flat, offsets = split.flatten(), split.offsets.to_numpy()
    full = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    upto = np.concatenate([[0], np.cumsum(full)])
    return flat.filter(pa.array(full)), upto[offsets - offsets[0]]


def made_periodic(key: int | None, n: int) -> np.ndarray | None:
    """For every tenth key by checksum: which word stands at each place, so that the
    text ends in a periodic stretch. None: the text stays as it is, also for null keys."""
    if key is None or not n:
        return None
    h = zlib.crc32(str(key).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    at = np.arange(n)
    at[a:] = a + (at[a:] - a) % p
    return at


def _judged(keys: list, texts: pa.LargeBinaryArray, planted: bool) -> Iterator[tuple[list[Run], str]]:
    """For each text its runs and its words without repetitions, joined by blanks."""
    flat, borders = _words(texts)
    if planted:
        place = np.arange(len(flat))
        for key, a, b in zip(keys, borders[:-1], borders[1:]):
            moved = made_periodic(key, int(b - a))
            if moved is not None:
                place[a:b] = a + moved
        flat = flat.take(pa.array(place))
    number = flat.dictionary_encode().indices.to_numpy().astype(np.int64)
    runs = found_runs(number, borders)
    kept = np.ones(len(flat), bool)
    for k, found in enumerate(runs):
        if found:
            a, b = borders[k], borders[k + 1]
            kept[a:b] = ~repeated_words(found, int(b - a))
    upto = np.concatenate([[0], np.cumsum(kept)])
    lists = pa.LargeListArray.from_arrays(pa.array(upto[borders]), flat.filter(pa.array(kept)))
    yield from zip(runs, pc.binary_join(lists, pa.scalar(" ", pa.large_string())).to_pylist())


def _per_text(
    docs: DataFrame, key: str, text: str, planted: bool, schema: str, row
) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole, keys = _as_utf8(batch.column(1)), batch.column(0)
            for a, b in _portions(whole):
                own = keys.slice(a, b - a)
                judged = _judged(own.to_pylist() if planted else [], whole.slice(a, b - a), planted)
                columns = list(zip(*(row(runs, words) for runs, words in judged)))
                kinds = [f.type for f in target][1:]
                yield pa.RecordBatch.from_arrays(
                    [own, *(pa.array(c, k) for c, k in zip(columns, kinds))], schema=target
                )

    given = docs.select(F.col(f"`{key}`"), F.col(f"`{text}`").cast("binary").alias("_text"))
    whole = T.StructType([T.StructField(key, docs.schema[key].dataType), *T.StructType.fromDDL(schema)])
    target = pa.schema([pa.field(f.name, f.type) for f in to_arrow_schema(whole)])
    return given.mapInArrow(work, whole)


def periodic_runs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``runs`` (start, length and period in words, by start, then period) and
    ``collapsed``: the words without those that a run has after its first period, joined
    by blanks. One row for each row of ``docs``; null texts count as empty and have no
    runs, null keys stay null, and an empty table gives no rows."""

    def row(runs: list[Run], words: str) -> tuple:
        return [{"start": s, "length": n, "period": q} for s, n, q in runs], words

    schema = "runs array<struct<start:long,length:long,period:long>>, collapsed string"
    return _per_text(docs, key, text, False, schema, row)


def digests(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``docs``: key, ``n_runs``, the strongest run's ``start``, ``length``,
    ``period`` and ``exponent_milli`` (null without runs), and the digests of all runs
    and of the collapsed text. Every tenth text by its key's checksum is made periodic
    first (``made_periodic``); one with a null key isn't. Null texts count as empty;
    repeated rows get equal results; an empty table gives no rows."""

    def row(runs: list[Run], words: str) -> tuple:
        best = strongest(runs)
        shown = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        measures = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        digest = [hashlib.sha256(x.encode()).hexdigest() for x in (shown, words)]
        return (len(runs), *measures, *digest)

    schema = (
        "n_runs long, start long, length long, period long, exponent_milli long, "
        "runs_sha256 string, collapsed_sha256 string"
    )
    return _per_text(docs, key, text, True, schema, row)
