"""Exact duplicates by deterministic block naming.

Texts are cut into blocks of a fixed number of characters. The distinct blocks are
sorted and each gets an integer name; then adjacent names are paired, the distinct
pairs are sorted and named in turn, and so on until one name is left for each
document. Names stand for contents one to one, so two documents with as many blocks
have the same last name if and only if their texts are equal.

A block travels once, when the distinct blocks are brought together; equal blocks of
one task have been merged before. Everything after that moves integers. The blocks'
128-bit fingerprints only carry the names back: that no two different blocks share
one is checked, and if two did, the names would travel by the blocks themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salestide.llm.tables import cut, let, saved, unused

BLOCK_CHARS = 4096


def _fingerprint(text: Column) -> Column:
    return F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit(1), text).alias("b"))


def _blocks(text: Column, size: int) -> Column:
    """Blocks in order; an empty text is one empty block."""
    count = F.greatest(F.lit(1), F.ceil(F.length(text) / size).cast("int"))
    return let(
        text,
        lambda t: F.transform(
            F.sequence(F.lit(0), count - 1), lambda i: F.substring(t, i * size + 1, F.lit(size))
        ),
    )


def _named(distinct: DataFrame, *columns: str) -> DataFrame:
    """Adds ``name``, an integer that increases in the order of the sorted rows of
    each partition. Written down, so that every reader sees the same names."""
    ordered = distinct.sortWithinPartitions(*columns)
    return ordered.withColumn("name", F.monotonically_increasing_id())


def with_identity(
    docs: DataFrame, key: str = "doc_id", text: str = "text", block_chars: int = BLOCK_CHARS
) -> DataFrame:
    """One row for each distinct (key, text): ``key``, ``n_rows``, ``text_sha256``,
    ``n_blocks`` and ``name``. Texts are equal exactly where n_blocks and name are.

    A null text counts as empty; a null key is a key like any other.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    whole = docs.select(F.col(key).alias("_key"), F.sha2(body, 256).alias("_sha"), body.alias("_t"))
    blocks = whole.select(
        "_key", "_sha", F.posexplode(_blocks(F.col("_t"), block_chars)).alias("_no", "_block")
    ).withColumn("_fp", _fingerprint(F.col("_block")))

    distinct = blocks.groupBy("_fp", "_block").agg(F.count("*").alias("_times"))
    # A hash of the block is enough to tell whether a fingerprint is ambiguous.
    names = saved(
        _named(distinct, "_block", "_fp").select(
            "_fp", "name", F.sha2("_block", 256).alias("_block_sha")
        ),
        "block-names",
    )
    shared = names.groupBy("_fp").count().where("count > 1").limit(1).count()
    on, names = (["_fp"], names.drop("_block_sha")) if not shared else (["_fp", "_block_sha"], names)
    placed = blocks.withColumn("_block_sha", F.sha2("_block", 256)) if shared else blocks
    # Repeated rows (same key, same text) meet here and are counted.
    level = cut(
        placed.select("_key", "_sha", "_no", *on)
        .groupBy("_key", "_sha", "_no", *on)
        .agg(F.count("*").alias("n_rows"))
        .join(names, on)
        .select("_key", "_sha", "_no", "n_rows", "name")
    )
    lengths = level.groupBy("_key", "_sha").agg((F.max("_no") + 1).alias("n_blocks"))
    longest = lengths.agg(F.max("n_blocks")).first()[0] or 1
    level = level.join(lengths.withColumnsRenamed({"_key": "_k", "_sha": "_s"}), _same_document())
    level = cut(level.drop("_k", "_s"))

    done, width = [level.where("n_blocks = 1")], longest
    rest = level.where("n_blocks > 1").withColumn("_left", F.col("n_blocks"))
    while width > 1:
        pairs = rest.groupBy(
            "_key", "_sha", "n_rows", "n_blocks", "_left", F.floor(F.col("_no") / 2).alias("_no")
        ).agg(
            F.max(F.when(F.col("_no") % 2 == 0, F.col("name"))).alias("_a"),
            # A last name without a neighbour is paired with -1, which names nothing.
            F.coalesce(F.max(F.when(F.col("_no") % 2 == 1, F.col("name"))), F.lit(-1)).alias("_b"),
        )
        pairs = cut(pairs.withColumn("_left", F.ceil(F.col("_left") / 2)))
        pair_names = cut(_named(pairs.select("_a", "_b").distinct(), "_a", "_b"))
        rest = cut(pairs.join(pair_names, ["_a", "_b"]).drop("_a", "_b"))
        done.append(rest.where("_left = 1").drop("_left"))
        rest = rest.where("_left > 1")
        width = (width + 1) // 2
    columns = ["_key", "_sha", "n_rows", "n_blocks", "name"]
    everything = done[0].select(columns)
    for part in done[1:]:
        everything = everything.unionByName(part.select(columns))
    return everything.withColumnsRenamed({"_key": key, "_sha": "text_sha256"})


def _same_document() -> Column:
    return F.col("_key").eqNullSafe(F.col("_k")) & (F.col("_sha") == F.col("_s"))


def duplicate_groups(
    docs: DataFrame, key: str = "doc_id", text: str = "text", block_chars: int = BLOCK_CHARS
) -> DataFrame:
    """Which document stays of each group of equal texts.

    One row for each distinct (key, text): key, ``keep_id`` (largest key of the group;
    null only if all are), ``group_size`` (rows, repeated ones included), ``kept`` and
    ``text_sha256``. Rows repeated with the same key and text are one document of
    several rows. Two texts under one key are two documents. Other columns are
    ignored. An empty table gives no rows.
    """
    named = cut(with_identity(docs, key, text, block_chars))
    # Cut, so that the join deals out both sides itself and can split a large group.
    groups = cut(
        named.groupBy("n_blocks", "name").agg(
            F.max(key).alias("keep_id"), F.sum("n_rows").alias("group_size")
        )
    )
    return named.join(groups, ["n_blocks", "name"]).select(
        key,
        "keep_id",
        "group_size",
        F.col(key).eqNullSafe(F.col("keep_id")).alias("kept"),
        "text_sha256",
    )


def without_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns, one for each distinct text.

    A null text is an empty one. Where rows repeat key and text, any one of them stays.
    A null key stays only if all of its group are null. An empty table gives no rows."""
    own, sha, own_sha = (unused(docs, n) for n in ("_own", "_sha", "_own_sha"))
    kept = duplicate_groups(docs, key, text).where("kept").select(
        F.col(key).alias(own), F.col("text_sha256").alias(own_sha)
    )
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = docs.withColumn(sha, F.sha2(whole, 256)).join(
        kept, F.col(f"`{key}`").eqNullSafe(F.col(own)) & (F.col(sha) == F.col(own_sha)), "left_semi"
    )
    return rows.dropDuplicates([key, sha]).drop(sha)
