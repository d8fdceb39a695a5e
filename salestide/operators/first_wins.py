"""Insert-or-ignore on a primary key: the first row per key is kept whole."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Orderable column giving each input row's place; kept until rows are chosen.
POSITION = "_position"


@dataclass(frozen=True)
class StoredKeys:
    """The keys of a stored table: those with an index, which lies spread over
    ``buckets`` by key, and those of loads too small to have one."""

    indexed: DataFrame | None
    buckets: int
    recent: DataFrame | None


def first_wins(rows: DataFrame, key: str) -> DataFrame:
    """The row with the smallest position per key, null attributes included.

    An aggregate, not a window: every task reduces its own rows to one per key
    before the shuffle, so a key that holds a third of the input costs no more
    than any other.
    """
    attributes = [c for c in rows.columns if c not in (key, POSITION)]
    first = F.min_by(F.struct(*attributes), F.col(POSITION)).alias("first")
    return rows.groupBy(key).agg(first).select(key, "first.*")


def stored_matches(stored: DataFrame, candidates: DataFrame, key: str) -> DataFrame:
    """Keys of ``candidates`` that are already stored.

    The candidate keys are broadcast: call only after checking their size. The
    stored table is then scanned for one column and not shuffled, and the result
    is no larger than the candidates.
    """
    incoming = F.broadcast(candidates.select(key).distinct())
    return stored.select(key).join(incoming, key, "left_semi")


def not_indexed(candidates: DataFrame, keys: StoredKeys, key: str) -> DataFrame:
    """First row per key, for keys that are not stored.

    The new rows are dealt out as the index is, so each bucket of it is read where it
    is needed and nothing stored is shuffled. Keys without an index are few: they come
    from loads whose keys fit a broadcast, since the last compaction.
    """
    new = first_wins(candidates, key)
    if keys.indexed is not None:
        new = new.repartition(keys.buckets, key).join(keys.indexed, key, "left_anti")
    return new if keys.recent is None else new.join(keys.recent, key, "left_anti")


def insert_or_ignore(
    candidates: DataFrame,
    stored: DataFrame | None,
    key: str,
    *,
    keys_fit_broadcast: bool = False,
    stored_keys: StoredKeys | None = None,
) -> DataFrame:
    """Rows to insert: first row per key, for keys not stored yet.

    ``keys_fit_broadcast`` is the caller's statement that the candidate keys were
    measured and are small. Small loads never move the stored table. Large ones
    reduce to one row per key first and then anti-join: with the key index if the
    caller has one, else on the partitioning that the reduction left. Neither side of
    the join has a repeated key.
    """
    if stored is None:
        return first_wins(candidates, key)
    if keys_fit_broadcast:
        taken = F.broadcast(stored_matches(stored, candidates, key))
        return first_wins(candidates.join(taken, key, "left_anti"), key)
    if stored_keys is not None:
        return not_indexed(candidates, stored_keys, key)
    return first_wins(candidates, key).join(stored.select(key), key, "left_anti")
