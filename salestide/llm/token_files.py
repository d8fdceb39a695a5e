"""Token ids in raw binary shards, with a minimal perfect hash index over the keys.

Format, under one folder:

- ``ids/part-NNNNN.ids``: ids as little-endian unsigned 16-bit integers (32-bit if
  the vocabulary needs it), documents one after the other in ascending key order,
  each followed by the end id. Nothing else is in these files.
- ``records``: Parquet, one row for each document: key, occurrence, shard, offset (in
  ids from the shard's start) and n_tokens.
- ``index``: Parquet, one row for each index part of about 50,000 keys. A key's hash
  names its part; in the part, a minimal perfect hash names its slot, and the slot
  holds a 32-bit fingerprint of the key, the shard, the offset and the length.

Finding a document reads one index row, computes a few hashes, compares the
fingerprint and seeks into one shard. Keys that aren't there are refused by their
fingerprints, but for one in 2^32.

A shard is what one task of the key-ordered table holds. Shards are written under
another name and then renamed, with contents that depend on the rows alone, so a task
that runs again leaves the same file.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from salestide.llm.tables import cut, new_path
from salestide.llm.word_pieces import ADDED, forget, spelled, words_of_all

KEYS_IN_PART = 50_000
KNOWN_PIECES = 800_000
KNOWN_WORDS = 400_000
TEXTS_AT_ONCE = 2000
LEVELS = 64
GAMMA = 2.0


class LibraryEncoder:
    """Ids by the tokenizers library, asked once for each word it hasn't met."""

    def __init__(self, path: str, dtype: str) -> None:
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        # It gets words that are normalised and split already, one on each line.
        self.tokenizer.normalizer = None
        self.tokenizer.pre_tokenizer = pre_tokenizers.Sequence(
            [
                pre_tokenizers.WhitespaceSplit(),
                pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False),
            ]
        )
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.dtype = np.dtype(dtype)
        vocabulary = self.tokenizer.get_vocab()
        if max(vocabulary.values()) > np.iinfo(self.dtype).max:
            raise ValueError(f"the vocabulary has ids beyond {dtype}: choose '<u4'")
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)  # ids that end a word
        self.last[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.pieces: dict[str, bytes] = {}
        self.words = {w: np.array([i], self.dtype).tobytes() for w, i in ADDED.items()}

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return spelled(texts, self.pieces, self._pieces, KNOWN_PIECES, self.dtype)

    def _pieces(self, new: set[str]) -> dict[str, bytes]:
        inside = words_of_all(new)
        known = self.words
        unknown = {w for ws in inside.values() for w in ws if w not in known}
        known.update(self._words(list(unknown)))
        out = {
            p: known[ws[0]] if len(ws) == 1 else b"".join([known[w] for w in ws])
            for p, ws in inside.items()
        }
        forget(known, unknown, KNOWN_WORDS)
        return out

    def _words(self, unknown: list[str]) -> dict[str, bytes]:
        """Words without white space, encoded as the lines of one text."""
        if not unknown:
            return {}
        lines = ["\n".join(unknown)]
        ids = np.array(
            self.tokenizer.encode_batch_fast(lines, add_special_tokens=False)[0].ids, np.int64
        )
        ends = np.flatnonzero(self.last[ids]) + 1
        if len(ends) != len(unknown):
            raise ValueError("the tokenizer splits words otherwise than expected")
        raw, size = ids.astype(self.dtype).tobytes(), self.dtype.itemsize
        stops = (ends * size).tolist()
        return {w: raw[a:b] for w, a, b in zip(unknown, [0, *stops], stops)}


@lru_cache(maxsize=2)
def _encoder(path: str, dtype: str) -> LibraryEncoder:
    return LibraryEncoder(path, dtype)


def _mixed(keys: np.ndarray, salt: int) -> np.ndarray:
    """64-bit finalizer; one to one for a given salt."""
    x = keys.astype(np.uint64) + np.uint64((salt * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _hashed(keys: np.ndarray, occurrences: np.ndarray) -> np.ndarray:
    return _mixed(_mixed(keys.view(np.uint64), 1) ^ _mixed(occurrences, 2), 3)


class PerfectHash:
    """Minimal perfect hash: keys alone in their place of a bit array have its rank
    as slot; the others try again in the next, smaller array."""

    def __init__(self, levels: list[np.ndarray]) -> None:
        self.levels = levels
        self.ranks, first = [], 0
        for bits in levels:
            before = np.cumsum(bits, dtype=np.int64)
            self.ranks.append(before - 1 + first)
            first += int(before[-1])
        self.size = first

    @classmethod
    def of(cls, hashes: np.ndarray) -> PerfectHash:
        levels = []
        while len(hashes):
            if len(levels) == LEVELS:
                raise ValueError("two keys of an index part have one 64-bit hash")
            size = max(64, int(GAMMA * len(hashes)))
            place = _mixed(hashes, 10 + len(levels)) % np.uint64(size)
            alone = np.bincount(place.astype(np.int64), minlength=size) == 1
            levels.append(alone)
            hashes = hashes[~alone[place.astype(np.int64)]]
        return cls(levels)

    def slots(self, hashes: np.ndarray) -> np.ndarray:
        """The slot of each key; -1 for some that aren't there."""
        out = np.full(len(hashes), -1, np.int64)
        left = np.arange(len(hashes))
        for level, (bits, rank) in enumerate(zip(self.levels, self.ranks)):
            place = (_mixed(hashes[left], 10 + level) % np.uint64(len(bits))).astype(np.int64)
            hit = bits[place]
            out[left[hit]] = rank[place[hit]]
            left = left[~hit]
        return out

    def to_bytes(self) -> bytes:
        sizes = struct.pack(f"<{len(self.levels) + 1}q", len(self.levels), *map(len, self.levels))
        return sizes + b"".join(np.packbits(b).tobytes() for b in self.levels)

    @classmethod
    def from_bytes(cls, raw: bytes) -> PerfectHash:
        n = struct.unpack_from("<q", raw)[0]
        sizes, at, levels = struct.unpack_from(f"<{n}q", raw, 8), 8 * (n + 1), []
        for size in sizes:
            packed = np.frombuffer(raw, np.uint8, (size + 7) // 8, at)
            levels.append(np.unpackbits(packed, count=size).astype(bool))
            at += (size + 7) // 8
        return cls(levels)


def _opened(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


def _shard_path(folder: str, shard: int) -> str:
    return f"{folder}/ids/part-{shard:05d}.ids"


_ENTRY = np.dtype([("fingerprint", "<u4"), ("shard", "<i4"), ("offset", "<i8"), ("n", "<i8")])


def write(
    docs: DataFrame,
    path: str,
    end_id: int,
    folder: str | None = None,
    key: str = "doc_id",
    text: str = "text",
    dtype: str = "<u2",
) -> str:
    """Writes the files for all rows of ``docs`` and returns their folder.

    Keys are integers. Null texts count as empty and hold the end id only. A null key
    counts as the smallest key there is. Rows that share a key stand next to each
    other, by text, and are told apart by their occurrence 0, 1, ... Other columns
    are ignored. An empty table gives an empty index.
    """
    spark = docs.sparkSession
    folder = folder or new_path(spark, "token-files")
    end = np.array([end_id], dtype).tobytes()
    smallest = F.lit(-(1 << 63))
    rows = docs.select(
        F.coalesce(F.col(key).cast("long"), smallest).alias("key"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    )

    def shards(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task = TaskContext.get()
        shard, place, opened = task.partitionId(), 0, None
        before, occurrence = None, 0
        for batch in batches:
            if opened is None:
                system, final = _opened(_shard_path(folder, shard))
                system.create_dir(final.rsplit("/", 1)[0], recursive=True)
                unfinished = f"{final}.{task.taskAttemptId()}"
                opened = system.open_output_stream(unfinished)
            lengths, occurrences = [], []
            texts = iter(batch["text"])
            while portion := list(islice(texts, TEXTS_AT_ONCE)):
                for ids in _encoder(path, dtype).encode(portion):
                    opened.write(ids.tobytes() + end)
                    lengths.append(len(ids) + 1)
            for k in batch["key"].tolist():
                occurrence = occurrence + 1 if k == before else 0
                before = k
                occurrences.append(occurrence)
            n = np.array(lengths, np.int64)
            offsets = place + np.cumsum(n) - n
            place += int(n.sum())
            yield pd.DataFrame(
                {"key": batch["key"], "occurrence": occurrences, "shard": shard, "offset": offsets, "n_tokens": n}
            )
        if opened is not None:
            opened.close()
            system.move(unfinished, final)

    ordered = rows.repartitionByRange("key").sortWithinPartitions("key", "text")
    kind = "key long, occurrence long, shard int, offset long, n_tokens long"
    ordered.mapInPandas(shards, kind).write.parquet(f"{folder}/records")
    _write_index(spark, folder)
    return folder


def _write_index(spark: SparkSession, folder: str) -> None:
    records = spark.read.parquet(f"{folder}/records")
    n_parts = max(1, -(-records.count() // KEYS_IN_PART))

    def build(part: pd.DataFrame) -> pd.DataFrame:
        hashes = _hashed(part["key"].to_numpy(np.int64), part["occurrence"].to_numpy(np.int64))
        perfect = PerfectHash.of(hashes)
        entries = np.zeros(perfect.size, _ENTRY)
        slot = perfect.slots(hashes)
        entries["fingerprint"][slot] = _mixed(hashes, 4) >> np.uint64(32)
        for name, column in (("shard", "shard"), ("offset", "offset"), ("n", "n_tokens")):
            entries[name][slot] = part[column]
        return pd.DataFrame(
            {"part": part["part"].iloc[:1], "hash": [perfect.to_bytes()], "entries": [entries.tobytes()]}
        )

    parts = records.withColumn("part", _part(n_parts)).groupBy("part")
    built = parts.applyInPandas(build, "part long, hash binary, entries binary")
    built.withColumn("n_parts", F.lit(n_parts)).write.parquet(f"{folder}/index")


def _part(n_parts: int):
    return F.pmod(F.xxhash64("key", "occurrence"), F.lit(n_parts))


def located(wanted: DataFrame, folder: str) -> DataFrame:
    """``key``, ``occurrence``, ``shard``, ``offset`` and ``n_tokens`` for the rows
    (key, occurrence) of ``wanted`` that the index knows. Each index part meets the
    keys that belong to it; repeated questions get repeated answers."""
    index = wanted.sparkSession.read.parquet(f"{folder}/index")
    first = index.select("n_parts").first()
    n_parts = first[0] if first else 1

    def look_up(asked: pd.DataFrame, part: pd.DataFrame) -> pd.DataFrame:
        names = ["key", "occurrence", "shard", "offset", "n_tokens"]
        if asked.empty or part.empty:
            return pd.DataFrame({n: np.array([], np.int64) for n in names})
        hashes = _hashed(asked["key"].to_numpy(np.int64), asked["occurrence"].to_numpy(np.int64))
        slot = PerfectHash.from_bytes(part["hash"].iloc[0]).slots(hashes)
        entries = np.frombuffer(part["entries"].iloc[0], _ENTRY)
        found = (slot >= 0) & (
            entries["fingerprint"][slot] == (_mixed(hashes, 4) >> np.uint64(32)).astype(np.uint32)
        )
        entry = entries[slot[found]]
        return pd.DataFrame(
            {
                "key": asked["key"][found].to_numpy(),
                "occurrence": asked["occurrence"][found].to_numpy(),
                "shard": entry["shard"].astype(np.int32),
                "offset": entry["offset"].astype(np.int64),
                "n_tokens": entry["n"].astype(np.int64),
            }
        )

    kind = "key long, occurrence long, shard int, offset long, n_tokens long"
    asked = wanted.select("key", "occurrence").withColumn("part", _part(n_parts))
    return asked.groupBy("part").cogroup(index.groupBy("part")).applyInPandas(look_up, kind)


def payload_digests(places: DataFrame, folder: str, dtype: str = "<u2") -> DataFrame:
    """Adds ``ids_crc32``, the checksum of each place's ids as little-endian unsigned
    32-bit integers, by seeking to them in the shards. Places of one shard are read
    by one task, in order of their offsets."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard, opened = None, None
        width = np.dtype(dtype).itemsize
        for batch in batches:
            checks = []
            for s, offset, n in zip(batch["shard"], batch["offset"], batch["n_tokens"]):
                if s != shard:
                    if opened is not None:
                        opened.close()
                    system, final = _opened(_shard_path(folder, s))
                    shard, opened = s, system.open_input_file(final)
                opened.seek(int(offset) * width)
                ids = np.frombuffer(opened.read(int(n) * width), dtype)
                checks.append(zlib.crc32(ids.astype("<u4").tobytes()))
            yield batch.assign(ids_crc32=np.array(checks, np.int64))
        if opened is not None:
            opened.close()

    columns = ["key", "occurrence", "shard", "offset", "n_tokens"]
    kind = "key long, occurrence long, shard int, offset long, n_tokens long, ids_crc32 long"
    by_shard = places.select(columns).repartition("shard").sortWithinPartitions("shard", "offset")
    return by_shard.mapInPandas(read, kind)


def shard_starts(spark: SparkSession, folder: str) -> DataFrame:
    """``shard`` and ``shard_start``: ids in all shards before it. One row a shard."""
    sizes = spark.read.parquet(f"{folder}/records").groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("shard_start", F.coalesce(F.sum("n").over(before), F.lit(0)))
    return cut(starts.select("shard", "shard_start"))


def written_documents(
    docs: DataFrame, path: str, end_id: int, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Writes the files, finds every row of ``docs`` again through the index and reads
    its ids back: key, ``start``, ``n_tokens``, ``ids_crc32`` and ``shard``."""
    spark = docs.sparkSession
    folder = write(docs, path, end_id, key=key, text=text)
    smallest = F.lit(-(1 << 63))
    keys = docs.select(F.coalesce(F.col(key).cast("long"), smallest).alias("key"))
    wanted = keys.groupBy("key").agg(F.count("*").alias("_n")).select(
        "key", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)).alias("occurrence")
    )
    read = payload_digests(located(wanted, folder), folder)
    starts = shard_starts(spark, folder)
    return read.join(starts, "shard").select(
        F.when(F.col("key") != smallest, F.col("key")).alias(key),
        (F.col("shard_start") + F.col("offset")).alias("start"),
        "n_tokens",
        "ids_crc32",
        "shard",
    )
