"""Repeated passages by prefix-free parsing.

Every text is cut at triggers: places where a rolling hash of eight bytes is 0 modulo
a fixed number. Whether eight bytes are a trigger depends on them alone, so a passage
is cut alike wherever it stands. A phrase runs from one trigger to the end of the next
and so overlaps it; no phrase's tail is a prefix of another's, and the place of a
suffix in corpus order follows from the rest of its phrase and the order of what comes
after. Here that order is needed to the depth of 400 bytes only.

The dictionary: phrases are counted by content, and what holds a phrase that stands
only once in the corpus is not repeated. That removes nearly all unrepeated text.

The parse: a window of 400 bytes lies over a row of whole phrases (its core), the rest
of the phrase it starts in, and the beginning of the phrase it ends in. Windows are
equal exactly if their cores and both rests are. All windows over one core and between
the same two phrases are answered together: if that row of phrases, with both
neighbours, stands elsewhere too, all of them repeat. Only where equal cores have
different neighbours, at the edges of repeated passages, are the windows sorted one by
one. Windows that hold fewer than two triggers have no core and are always sorted one
by one.

Phrases, cores and windows are compared by 128 bits of hash, the first filter by 64.

Windows of a number of words can be asked for beside those of 400 bytes, for passages
too short for these. They go through the same steps: a window's core is the least of its
rows of 16 words by hash (its anchor), and only anchors that stand more than once in the
corpus are followed. Places in words are kept as -1 - place, apart from those in bytes.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache, partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from salestide.llm.tables import new_path, saved, word_count

LENGTH = 400
TRIGGER = 8
EVERY = 48
ANCHOR = 16

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True

_A = np.uint64(0x9E3779B97F4A7C15)
_B = np.uint64(0xC2B2AE3D27D4EB4F)


@lru_cache(maxsize=4)
def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(base, -1, 1 << 64)
    up, down = np.full(n, base, np.uint64), np.full(n, inverse, np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


class Hashed:
    """A text, or any row of numbers, whose substrings' 64-bit hashes, two independent
    ones, cost one subtraction each. ``other`` makes the numbers for the second hash if
    they differ; sums are made once a hash is asked for."""

    def __init__(self, raw: np.ndarray, other: Callable[[], np.ndarray] | None = None) -> None:
        self.raw, self.other = raw, other
        self.sums: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def _sums(self, which: int) -> tuple[np.ndarray, np.ndarray]:
        if which not in self.sums:
            base, salt = ((int(_A), 1), (int(_B), 77))[which]
            values = self.other() if which and self.other else self.raw
            up, down = _powers(base, 1 << max(12, (len(values) + 1).bit_length()))
            total = np.zeros(len(values) + 1, np.uint64)
            np.cumsum((values.astype(np.uint64) + np.uint64(salt)) * up[: len(values)], out=total[1:])
            self.sums[which] = total, down
        return self.sums[which]

    def __len__(self) -> int:
        return len(self.raw)

    def of(self, start: np.ndarray, end: np.ndarray, which: int) -> np.ndarray:
        total, down = self._sums(which)
        return _mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64) * _B)

    def triggers(self) -> np.ndarray:
        """Starts of the eight-byte strings that are triggers."""
        start = np.arange(max(0, len(self) - TRIGGER + 1))
        return start[self.of(start, start + TRIGGER, 0) % np.uint64(EVERY) == 0]

    def words(self) -> Hashed:
        """The words of a text, each by its two hashes."""
        edges = np.flatnonzero(np.diff(np.concatenate([[True], _SPACE[self.raw], [True]])))
        start, end = edges[::2], edges[1::2]
        return Hashed(self.of(start, end, 0), lambda: self.of(start, end, 1))


def phrases(text: Hashed) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the whole phrases, from trigger to trigger."""
    at = text.triggers()
    return at[:-1], at[1:] + TRIGGER


def _windows_by_core(text: Hashed) -> tuple[np.ndarray, ...]:
    """The windows of a text as runs that share a core: first and last start of each
    run, and its first and last trigger (the same place in ``triggers``, or -1 where
    windows hold fewer than two triggers)."""
    at = text.triggers()
    n = len(text) - LENGTH + 1
    if n <= 0:
        empty = np.array([], np.int64)
        return at, empty, empty, empty, empty
    # A run ends where the window's start passes a trigger or its end takes one in.
    borders = np.concatenate([[0], at + 1, at + TRIGGER - LENGTH, [n]])
    borders = np.unique(borders[(borders >= 0) & (borders <= n)])
    first, last = borders[:-1], borders[1:] - 1
    left = np.searchsorted(at, first, "left")
    right = np.searchsorted(at, first + LENGTH - TRIGGER, "right") - 1
    whole = right > left
    return at, first, last, np.where(whole, left, -1), np.where(whole, right, -1)


def _windows_by_anchor(words: Hashed, length: int) -> tuple[np.ndarray, ...]:
    """The windows of so many words as runs that share an anchor: the anchor's place and
    key, and the first and last start of each run. Equal windows have equal anchors, at
    the same place in the window."""
    if len(words) < length:
        return tuple(np.array([], t) for t in (np.int64, np.int64, np.int64, np.int64))
    size = min(ANCHOR, length)
    place = np.arange(len(words) - size + 1)
    rows = words.of(place, place + size, 0)
    least = np.lib.stride_tricks.sliding_window_view(rows, length - size + 1).argmin(axis=1)
    least += np.arange(len(least))
    new = np.flatnonzero(np.diff(least)) + 1
    first = np.concatenate([[0], new])
    last = np.concatenate([new, [len(least)]]) - 1
    return least[first], _signed(_mix(rows[least[first]] + _A)), first, last


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _rows(batch: pd.DataFrame) -> Iterator[tuple[object, Hashed]]:
    for key, text in zip(batch["_id"], batch["_text"]):
        yield key, Hashed(np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8))


def _first_of(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row, is it the first of its equals, and how many equals are there?"""
    order = np.lexsort(columns)
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.logical_or.reduce([c[order][1:] != c[order][:-1] for c in columns])
    group = np.cumsum(new) - 1
    first, times = np.zeros(len(order), bool), np.zeros(len(order), np.int64)
    first[order[new]] = True
    times[order] = np.bincount(group)[group] if len(order) else 0
    return first, times


def _deal(keys: np.ndarray, first: np.ndarray, ids: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Keys for the shuffle. Of the equals that one batch holds, one goes to where its
    key is counted; the others are known to repeat, and go anywhere."""
    anywhere = _signed(_mix(ids.view(np.uint64) * _A + places.astype(np.uint64)))
    return np.where(first, keys, anywhere)


def _phrase_keys(batches: Iterator[pd.DataFrame], words: int | None) -> Iterator[pd.DataFrame]:
    """Hash and place of each phrase and anchor, and how often the batch holds it."""
    for batch in batches:
        ids, places, keys = [], [], []
        for key, text in _rows(batch):
            if len(text) >= LENGTH:  # shorter ones hold no window
                start, end = phrases(text)
                ids.append(np.full(len(start), key, np.int64))
                places.append(np.arange(len(start), dtype=np.int64))
                keys.append(_signed(text.of(start, end, 0)))
            if words:
                at, anchor, _, _ = _windows_by_anchor(text.words(), words)
                ids.append(np.full(len(at), key, np.int64))
                places.append(-1 - at)
                keys.append(anchor)
        if ids:
            i, p, k = map(np.concatenate, (ids, places, keys))
            first, times = _first_of(k)
            yield pd.DataFrame({"key": _deal(k, first, i, p), "_id": i, "place": p, "n": times})


def _bitmap(places: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(n, bool)
    out[places] = True
    return out


def _core_rows(batches: Iterator[pd.DataFrame], words: int | None) -> Iterator[pd.DataFrame]:
    """Runs of windows over one core, where all its phrases are repeated: a hash of the
    core; two of all that the run's windows cover, with the core's place in it; where
    the run is; and how often the batch holds an equal one. Runs of windows without a
    core come with a 0 for that. So do runs of windows of words over one anchor."""
    for batch in batches:
        parts = []
        for (key, text), repeated in zip(_rows(batch), batch["_places"]):
            places = np.array(repeated if repeated is not None else [], np.int64)
            if words and (places < 0).any():
                said = text.words()
                found = _windows_by_anchor(said, words)
                again = np.isin(found[0], -1 - places[places < 0])
                at, core, first, last = (x[again] for x in found)
                inside = (at - first).astype(np.uint64)
                wide = [_signed(_mix(said.of(first, last + words, w) + inside * _A)) for w in (0, 1)]
                whose, cored = np.full(len(at), key, np.int64), np.ones(len(at), bool)
                parts.append((whose, -1 - last, -1 - first, core, *wide, cored))
            at, first, last, left, right = _windows_by_core(text)
            known = _bitmap(places[places >= 0], max(0, len(at) - 1))
            upto = np.concatenate([[0], np.cumsum(known)])
            cored = left >= 0
            good = ~cored
            good[cored] = upto[right[cored]] - upto[left[cored]] == right[cored] - left[cored]
            first, last, left, right, cored = (x[good] for x in (first, last, left, right, cored))
            if not len(first):
                continue
            spots = at if len(at) else np.zeros(1, np.int64)
            start = np.where(cored, spots[left], first)
            end = np.where(cored, spots[right] + TRIGGER, first)
            inside = (start - first).astype(np.uint64)
            core = text.of(start, end, 0)
            wide = [_signed(_mix(text.of(first, last + LENGTH, w) + inside * _A)) for w in (0, 1)]
            parts.append((np.full(len(first), key, np.int64), first, last, _signed(core), *wide, cored))
        if parts:
            ids, first, last, core, a, b, cored = map(np.concatenate, zip(*parts))
            one, times = _first_of(core, a, b)
            one |= ~cored
            yield pd.DataFrame(
                {
                    "core": _deal(np.where(cored, core, 0), one & cored, ids, first),
                    "a": a,
                    "b": b,
                    "_id": ids,
                    "first": first,
                    "last": last,
                    "n": np.where(cored, times, 0),
                    "one": one,
                }
            )


def _window_rows(batches: Iterator[pd.DataFrame], words: int | None) -> Iterator[pd.DataFrame]:
    """The windows of the runs asked for: two hashes, the start, and how often the
    batch holds an equal one."""
    for batch in batches:
        ids, starts, hashes = [], [], []
        for (key, text), runs in zip(_rows(batch), batch["_runs"]):
            start = np.concatenate([np.arange(r["first"], r["last"] + 1) for r in runs])
            ids.append(np.full(len(start), key, np.int64))
            starts.append(start)
            at, place = start[start >= 0], -1 - start[start < 0]
            said = text.words() if len(place) else text
            hashes.append(
                [
                    _signed(np.concatenate([text.of(at, at + LENGTH, w), _mix(said.of(place, place + (words or 0), w) + _A)]))
                    for w in (0, 1)
                ]
            )
            starts[-1] = np.concatenate([at, -1 - place])
        if ids:
            i, start = np.concatenate(ids), np.concatenate(starts)
            a, b = (np.concatenate([h[w] for h in hashes]) for w in (0, 1))
            first, times = _first_of(a, b)
            yield pd.DataFrame(
                {"a": _deal(a, first, i, start), "b": b, "_id": i, "start": start, "n": times}
            )


def _covered(first: np.ndarray, stop: np.ndarray, n: int) -> np.ndarray:
    change = np.bincount(first, minlength=n + 1) - np.bincount(stop, minlength=n + 1)
    return np.cumsum(change)[:n] > 0


def _digest_rows(batches: Iterator[pd.DataFrame], words: int | None) -> Iterator[pd.DataFrame]:
    """What is left of each text, by its digest, given the runs of windows that repeat."""
    for batch in batches:
        rows = []
        for text, runs in zip(batch["_text"], batch["_runs"]):
            data = (text or "").encode("utf-8", "surrogatepass")
            first = np.array([r["first"] for r in runs], np.int64)
            last = np.array([r["last"] for r in runs], np.int64)
            said = first < 0
            gone = _covered(first[~said], last[~said] + LENGTH, len(data))
            told = 0
            if said.any():
                start, stop = -1 - last[said], -1 - first[said] + words
                told = int(_covered(start, stop, int(stop.max())).sum())
            left = np.frombuffer(data, np.uint8)[~gone].tobytes()
            starts = np.flatnonzero(np.diff(np.concatenate([[False], gone]).astype(np.int8)) == 1)
            whole = hashlib.sha256(data).hexdigest()
            rows.append((whole, int(gone.sum()), len(starts), hashlib.sha256(left).hexdigest(), told))
        yield pd.DataFrame(rows, columns=["_sha", "n_removed", "n_spans", "kept_sha256", "n_repeated_words"])


def repeated_runs(texts: DataFrame, words: int | None = None) -> DataFrame:
    """``_id``, ``first``, ``last``: runs of starts of 400-byte windows that stand
    somewhere else too, from rows (_id, _text) with unique ids. With ``words``, also
    runs of windows of so many words, as -1 - start."""
    # The dictionary: phrases that stand more than once.
    keys = texts.mapInPandas(partial(_phrase_keys, words=words), "key long, _id long, place long, n long")
    often = keys.withColumn("n", F.sum("n").over(Window.partitionBy("key"))).where("n > 1")
    known = often.groupBy("_id").agg(F.collect_list("place").alias("_places"))

    # The parse: cores of repeated phrases. A run whose windows cover equal bytes as
    # another's is repeated whole. Where equal cores differ around, one run of each
    # kind is looked at window by window.
    kind = "core long, a long, b long, _id long, first long, last long, n long, one boolean"
    runs = texts.join(known, "_id", "left").mapInPandas(partial(_core_rows, words=words), kind)
    core, same = Window.partitionBy("core"), Window.partitionBy("core", "a", "b")
    place = F.struct("_id", "first")
    judged = runs.select(
        "_id",
        "first",
        "last",
        (F.sum("n").over(same) > 1).alias("whole"),
        (
            (F.col("n") == 0)  # no core
            | (
                F.col("one")
                & (F.min(F.struct("a", "b")).over(core) != F.max(F.struct("a", "b")).over(core))
                & (F.min(place).over(same) == place)
            )
        ).alias("asked"),
    )
    judged = saved(judged.where("whole or asked"), "runs")
    whole = judged.where("whole").select("_id", "first", "last")

    asked = judged.where("asked").groupBy("_id").agg(
        F.collect_list(F.struct("first", "last")).alias("_runs")
    )
    windows = texts.join(asked, "_id").mapInPandas(
        partial(_window_rows, words=words), "a long, b long, _id long, start long, n long"
    )
    again = windows.withColumn("n", F.sum("n").over(Window.partitionBy("a", "b"))).where("n > 1")
    # Neighbouring starts become one run. Long texts are numbered stretch by stretch.
    stretch = F.floor(F.col("start") / (1 << 16)).alias("stretch")
    starts = again.select("_id", stretch, "start")
    before = Window.partitionBy("_id", "stretch").orderBy("start")
    single = (
        starts.withColumn("run", F.col("start") - F.row_number().over(before))
        .groupBy("_id", "stretch", "run")
        .agg(F.min("start").alias("first"), F.max("start").alias("last"))
    )
    return whole.unionByName(single.select("_id", "first", "last"))


def _co_located(texts: DataFrame) -> DataFrame:
    """Written once as a table bucketed by id, so that the joins on the id that follow
    never move the texts again."""
    spark = texts.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"texts_{uuid.uuid4().hex}"
    path = new_path(spark, "texts")
    (
        texts.dropDuplicates(["_id"])
        .write.bucketBy(buckets, "_id")
        .option("path", path)
        .option("compression", "zstd")
        .format("parquet")
        .saveAsTable(name)
    )
    frame = spark.table(name)
    # The frame knows files and buckets by now; the catalog's entry goes, the files stay.
    spark.sql(f"DROP TABLE {name}")
    return frame


def _named_texts(rows: DataFrame, digits: int) -> tuple[DataFrame, DataFrame]:
    """``rows`` (with ``_sha``) with ``_id`` added, and ``copies``: (``_sha``, ``copies``).

    ``_id`` is one integer for each distinct text: the first digits of its digest, or,
    for digests that begin alike, a negative number of their own.
    """
    prefix = F.conv(F.substring("_sha", 1, digits), 16, 10).cast("long")
    copies = saved(rows.groupBy("_sha").agg(F.count("*").alias("copies")), "text-copies")
    shared = copies.groupBy(prefix.alias("_id")).agg(F.count("*").alias("n")).where("n > 1").drop("n")
    if shared.isEmpty():
        return rows.withColumn("_id", prefix), copies
    own = saved(
        copies.withColumn("_id", prefix)
        .join(shared, "_id", "left_semi")
        .select("_sha", (-1 - F.monotonically_increasing_id()).alias("_own")),
        "text-names",
    )
    named = rows.join(own, "_sha", "left").withColumn("_id", F.coalesce("_own", prefix))
    return named.drop("_own"), copies


def without_repeats(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    name_digits: int = 15,
    words: int | None = None,
) -> DataFrame:
    """``key``, ``n_bytes``, ``n_removed``, ``n_spans`` and ``kept_sha256`` for each row:
    bytes covered by a 400-byte string that also starts anywhere else are removed.

    A null text counts as empty. Rows are told apart by key and text; rows that repeat
    both are copies, so all of their text is repeated if it has 400 bytes, and they get
    one row each. Null keys are keys like any other. An empty table gives no rows.

    With ``words``, ``n_repeated_words`` follows: words covered by a row of so many words
    that also starts anywhere else, whatever whitespace is between them. They stay.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    sha = F.sha2(whole, 256)
    # Equal texts repeat each other whole, so one of each stands for all.
    rows = docs.select(F.col(key).alias("_key"), whole.alias("_text"), sha.alias("_sha"))
    if words:
        rows = rows.withColumn("_words", word_count(F.col("_text")))
    named, copies = _named_texts(rows, name_digits)
    texts = _co_located(named.select("_id", "_text"))
    runs = repeated_runs(texts, words).groupBy("_id").agg(
        F.collect_list(F.struct("first", "last")).alias("_runs")
    )
    cleaned = texts.join(runs, "_id").mapInPandas(
        partial(_digest_rows, words=words),
        "_sha string, n_removed long, n_spans long, kept_sha256 string, n_repeated_words long",
    )
    answers = copies.join(cleaned, "_sha", "left").select(
        "_sha", "copies", "n_removed", "n_spans", "kept_sha256", *(["n_repeated_words"] if words else [])
    )
    out = named.select(
        "_key", "_sha", F.octet_length("_text").cast("long").alias("n_bytes"), *(["_words"] if words else [])
    ).join(answers, "_sha")
    all_gone = (F.col("copies") > 1) & (F.col("n_bytes") >= LENGTH)
    told = []
    if words:
        all_told = (F.col("copies") > 1) & (F.col("_words") >= words)
        some = F.coalesce("n_repeated_words", F.lit(0))
        told = [F.when(all_told, F.col("_words")).otherwise(some).alias("n_repeated_words")]
    return out.select(
        F.col("_key").alias(key),
        "n_bytes",
        F.when(all_gone, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(all_gone, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(all_gone, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha256", "_sha")).alias("kept_sha256"),
        *told,
    )
