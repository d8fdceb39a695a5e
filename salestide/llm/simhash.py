"""Near-duplicates by SimHash, found with the binary Golay code.

Fingerprints have 64 bits; documents link when theirs differ in two bits or fewer.

The fingerprint is cut into three segments of 22, 21 and 21 bits. Two differing bits
leave one segment untouched, and the next segment (in a circle) differs in two bits
at most. Padded to 23 bits, that next segment is decoded to the codewords of the
perfect Golay code within distance four: one or six of them. Any two words at
distance two or less have one of these codewords in common. So the keys of a
fingerprint are (untouched segment, codeword of the next one): 3 or 18 keys, and
every link shares at least one. Fingerprints that meet under a key are compared.

A key under which many fingerprints meet is not compared pair by pair. Two
fingerprints differ in two bits or fewer exactly if some word differs from each in
one bit or none, so there every fingerprint names its 65 nearest words, and those
that name the same word are linked. At most 65 fingerprints can.

All of it works on distinct fingerprints; copies of a document never meet as pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salestide.llm.components import smallest_reachable
from salestide.llm.tables import cut, saved, unused

BITS = 64
MAX_DISTANCE = 2
SHINGLE = 3
SEED = 42
SEGMENTS = ((0, 22), (22, 21), (43, 21))
# Fixed value: generator polynomial of the (23, 12) Golay code.
GOLAY = 0b101011100011
#: Keys with more fingerprints than this are linked by nearest words.
COMPARED_AT_ONCE = 32


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Majority of the bits of the shingles' hashes; 0 for a text without words."""
    words = (text or "").encode().lower().split()  # bytes: only A-Z, only the six separators
    if not words:
        return 0
    joined = b" ".join(words)
    n = max(1, len(words) - shingle + 1)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[: n - 1] + 1).tolist()]
    stops = ends[min(shingle, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, stops)], "<u8")
    counts = np.zeros(BITS, np.int64)
    for at in range(0, n, 1 << 16):
        part = hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def _remainder(words: np.ndarray) -> np.ndarray:
    """Of 23-bit words, modulo the generator polynomial: the syndrome."""
    rest = words.copy()
    for bit in range(22, 10, -1):
        rest = np.where((rest >> bit) & 1, rest ^ (GOLAY << (bit - 11)), rest)
    return rest


@lru_cache(maxsize=1)
def golay_neighbours() -> tuple[np.ndarray, np.ndarray]:
    """By syndrome: the error patterns of weight four or less that lead to a codeword
    (rows of six, unused ones 0), and how many there are."""
    single = _remainder(1 << np.arange(23))
    patterns: list[list[int]] = [[] for _ in range(2048)]
    lighter = {0: [(0, 0, 0)]}  # weight: (pattern, syndrome, next free bit)
    for weight in range(5):
        for pattern, syndrome, _ in lighter[weight]:
            patterns[syndrome].append(pattern)
        lighter[weight + 1] = [
            (p | 1 << b, s ^ int(single[b]), b + 1)
            for p, s, first in lighter[weight]
            for b in range(first, 23)
        ]
    count = np.array([len(p) for p in patterns])
    table = np.zeros((2048, count.max()), np.int64)
    for s, p in enumerate(patterns):
        table[s, : len(p)] = p
    return table, count


def golay_keys(fingerprints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place of the fingerprint in the array, key) for all keys of all of them."""
    table, count = golay_neighbours()
    parts = [(fingerprints >> np.uint64(at)) & np.uint64((1 << n) - 1) for at, n in SEGMENTS]
    places, keys = [], []
    for k in range(3):
        same, near = parts[k], parts[(k + 1) % 3].astype(np.int64)
        syndrome = _remainder(near)
        n = count[syndrome]
        place = np.repeat(np.arange(len(near)), n)
        nth = np.arange(len(place)) - np.repeat(np.cumsum(n) - n, n)
        codeword = near[place] ^ table[syndrome[place], nth]
        # 2 bits for the segment, 22 for its content, 12 for the codeword's index.
        key = (np.uint64(k) << np.uint64(34)) | (same[place] << np.uint64(12))
        keys.append((key | (codeword >> 11).astype(np.uint64)).astype(np.int64))
        places.append(place)
    return np.concatenate(places), np.concatenate(keys)


def fingerprints(
    docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE
) -> DataFrame:
    """``key`` and ``fp`` (the 64 bits as a long) for each row."""

    def take(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = np.array([fingerprint(t, shingle) for t in batch["_text"]], np.uint64)
            yield pd.DataFrame({key: batch[key], "fp": found.view(np.int64)})

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, F.col(text).alias("_text")).mapInPandas(take, f"`{key}` {kind}, fp long")


def _keys(distinct: DataFrame) -> DataFrame:
    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            fps = batch["fp"].to_numpy(np.int64)
            place, key = golay_keys(fps.view(np.uint64))
            yield pd.DataFrame({"key": key, "fp": fps[place]})

    return distinct.select("fp").mapInPandas(spread, "key long, fp long")


def links(distinct: DataFrame) -> DataFrame:
    """Links (a, b), a < b, between different fingerprints. Every two at distance two
    or less are linked, directly or by way of others that are as near."""
    keys = saved(_keys(distinct), "golay-keys")
    sizes = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    met = cut(keys.join(sizes, "key"))
    few = met.where(F.col("n") <= COMPARED_AT_ONCE)
    compared = (
        few.select("key", F.col("fp").alias("a"))
        .join(few.select("key", F.col("fp").alias("b")), "key")
        .where(
            (F.col("a") < F.col("b"))
            & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MAX_DISTANCE)
        )
        .select("a", "b")
        .distinct()
    )
    flips = F.array(F.lit(0), *[F.lit(1 << b if b < 63 else -(1 << 63)) for b in range(BITS)])
    many = met.where(F.col("n") > COMPARED_AT_ONCE).select("fp").distinct()
    named = many.select(
        "fp", F.explode(F.transform(flips, lambda f: F.col("fp").bitwiseXOR(f))).alias("word")
    )
    together = named.groupBy("word").agg(F.array_sort(F.collect_set("fp")).alias("fps"))
    starred = (
        together.where(F.size("fps") > 1)
        .select(F.col("fps")[0].alias("a"), F.explode("fps").alias("b"))
        .where("a < b")
        .distinct()
    )
    return compared.unionByName(starred).distinct()


def near_duplicate_groups(
    docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE
) -> DataFrame:
    """``key``, ``fingerprint`` (16 hexadecimal digits) and ``component_id`` (smallest
    key reachable over links, its own included) for each row of ``docs``.

    A null or wordless text has fingerprint zero and links like any other. Rows
    repeated with one key stay rows, in the same component. Null keys are left out
    when the smallest key is sought. An empty table gives no rows.
    """
    rows = saved(fingerprints(docs, key, text, shingle), "fingerprints")
    distinct = cut(rows.groupBy("fp").agg(F.min(key).alias("_least")))
    found = cut(links(distinct))
    root = smallest_reachable(found)
    labels = distinct.join(root.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "_least", F.coalesce("root", "fp").alias("root")
    )
    labels = cut(labels)
    # Cut, so that the joins deal out both sides themselves and can split a hot key.
    least = cut(labels.groupBy("root").agg(F.min("_least").alias("component_id")))
    labels = cut(labels.join(least, "root").select("fp", "component_id"))
    return rows.join(labels, "fp").select(
        key, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows with the smallest key of their component, all columns kept.

    Null and wordless texts are one component. Rows with that key in another component
    are no such rows: where a key has several texts, each is judged by its own. Rows
    that repeat key and text stay together. An empty table gives no rows."""
    own, mark = unused(docs, "_own"), unused(docs, "_mark")
    groups = near_duplicate_groups(docs, key, text).withColumnRenamed(key, own)
    groups = cut(groups.select(own, "fingerprint", F.col(own).eqNullSafe(F.col("component_id")).alias("stays")))
    same_key = F.col(f"`{key}`").eqNullSafe(F.col(own))
    by_key = groups.groupBy(own).agg(F.min("stays").alias("all"), F.max("stays").alias("some")).where("some")
    rows = docs.join(by_key.where("all").select(own), same_key, "left_semi")
    several = cut(by_key.where("not all").select(own))
    if several.isEmpty():
        return rows

    @F.pandas_udf("string")
    def printed(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: f"{fingerprint(t, SHINGLE):016x}")

    left = groups.where("stays").join(several, own, "left_semi").select(own, F.col("fingerprint").alias(mark))
    mixed = docs.join(several, same_key, "left_semi").withColumn(f"{mark}_own", printed(F.col(f"`{text}`")))
    mixed = mixed.join(left, same_key & (F.col(f"{mark}_own") == F.col(mark)), "left_semi")
    return rows.unionByName(mixed.drop(f"{mark}_own"))
