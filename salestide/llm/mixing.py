"""Mixing sources to target weights by capped water-filling.

Targets: every source first gets its share by weight. Sources whose share exceeds
their cap are clamped to it, and what they cannot take is shared again among the
others in proportion to their weights, until nobody is above its cap.

Sampling: a target of 1.3 times a source's size takes every document once and a
seeded sample of documents holding 0.3 of the words a second time. The sample is the
start of the source in the order of a seeded hash. So that a source holding most of
the table needs no single sorted partition, hashes fall into ranges: whole ranges
below the cut are taken by their totals, and only rows of one range are ordered
against each other. A source's taken words miss its target by at most half of one
document.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from salestide.llm.tables import cut, in_order, saved, unused, word_count

HASH_RANGES = 1 << 14
SEED = 20_240_601


def source_targets(
    sizes: DataFrame, weights: Sequence[float], total_share: float, max_epochs: float
) -> DataFrame:
    """``source``, ``source_size``, ``target`` from rows of (source, size).

    Sources take the weights in turn, in code-point order, null last. Only scalars
    reach the driver; each round clamps all sources above their caps at once.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = in_order(totals, "source")
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    sources = cut(
        ranked.select(
            "source",
            "source_size",
            F.get(cycle, (F.col("_rank") % len(weights)).cast("int")).alias("weight"),
            (F.col("source_size") * float(max_epochs)).alias("cap"),
        )
    )
    to_share = float(sources.agg(F.sum("source_size")).first()[0] or 0) * total_share
    level = _water_level(sources, to_share)
    target = F.least(F.col("cap"), F.col("weight") * F.lit(level))
    return sources.select("source", "source_size", target.alias("target"))


def _water_level(sources: DataFrame, to_share: float) -> float:
    """Words for each unit of weight once no source is above its cap.

    The level only rises from round to round, so a clamped source stays clamped.
    """
    level = -1.0
    while True:
        clamped = F.col("weight") * F.lit(level) > F.col("cap")
        weight, taken = sources.agg(
            F.sum(F.when(~clamped, F.col("weight"))), F.sum(F.when(clamped, F.col("cap")))
        ).first()
        if not weight:  # everybody is at its cap, or there is nobody
            return max(level, 0.0)
        new = (to_share - (taken or 0.0)) / weight
        if new <= level:
            return level
        level = new


def _seeded_hash(key: Column, seed: int) -> Column:
    """Not negative, 63 bits."""
    return F.shiftrightunsigned(F.xxhash64(key, F.lit(seed)), 1)


def mix(
    docs: DataFrame,
    weights: Sequence[float] = (5, 2, 1),
    total_share: float = 1.5,
    max_epochs: float = 2.0,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    seed: int = SEED,
) -> DataFrame:
    """``key``, ``source``, ``size``, ``source_size``, ``target`` and ``taken`` for
    each row of ``docs``: ``taken`` is its size times the number of repetitions.

    Size is the number of words; null or blank texts have none and take none. Rows
    that share a key are ordered by their sizes, and equal ones take the same place
    in the sample one after the other. Null sources are one source, the last. An
    empty table gives no rows. Reruns give the same rows.
    """
    sized = saved(
        docs.select(
            F.col(key).alias("_key"),
            F.col(source).cast("string").alias("source"),
            word_count(F.col(text)).alias("size"),
        ).withColumn("_hash", _seeded_hash(F.col("_key"), seed)),
        "mix-sizes",
    )
    targets = source_targets(sized, weights, total_share, max_epochs)
    share = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    targets = cut(
        targets.withColumn("_whole", F.floor(share)).withColumn(
            "_rest", F.col("target") - F.col("_whole") * F.col("source_size")
        )
    )
    placed = sized.withColumn(
        "_range", F.shiftrightunsigned("_hash", 63 - (HASH_RANGES.bit_length() - 1))
    )
    ranges = placed.groupBy("source", "_range").agg(F.sum("size").alias("_in_range"))
    before = Window.partitionBy("source").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("_before", F.coalesce(F.sum("_in_range").over(before), F.lit(0)))
    plan = (
        ranges.join(
            targets.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))
        )
        .drop("_s", "_in_range")
        .withColumnsRenamed({"source": "_s", "_range": "_r"})
    )
    inside = (
        Window.partitionBy("source", "_range")
        .orderBy("_hash", "_key", "size")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    rows = placed.withColumn("_upto", F.sum("size").over(inside)).join(
        plan, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_range") == F.col("_r"))
    )
    # A document is in the sample if more than half of it lies before the cut.
    middle = F.col("_before") + F.col("_upto") - F.col("size") / 2
    times = F.col("_whole") + F.when(middle < F.col("_rest"), 1).otherwise(0)
    return rows.select(
        F.col("_key").alias(key),
        "source",
        "size",
        "source_size",
        "target",
        (times * F.col("size")).cast("long").alias("taken"),
    )


def mixed_rows(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken, all columns kept.

    Rows without words are not taken. Rows with one key count as documents of their
    own in the sizes, and all of them come as often as the one that is taken most.
    """
    taken = mix(docs, key=key, text=text, **options).where("taken > 0")
    own, times, copy = (unused(docs, n) for n in ("_own", "_times", "_copy"))
    often = F.max((F.col("taken") / F.col("size")).cast("int")).alias(times)
    plan = taken.groupBy(F.col(f"`{key}`").alias(own)).agg(often)
    rows = docs.join(plan, F.col(f"`{key}`").eqNullSafe(F.col(own)))
    copies = F.when(word_count(F.col(f"`{text}`")) > 0, F.sequence(F.lit(1), F.col(times)))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    return rows.select(*columns, F.explode(copies).alias(copy)).select(*columns)
