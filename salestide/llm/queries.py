"""The registered queries of this subpackage, with production parameters."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from salestide.llm import (
    bpe,
    byte_bpe,
    exact_dedup,
    language,
    license_scan,
    mixing,
    prefix_free,
    quality,
    secret_scan,
    simhash,
    token_files,
    whitening,
    word_runs,
)
from salestide.llm.tables import WORD, documents, ship_code, word_count

VOCABULARY = "word_bpe_49k.json"
RANKS = "byte_bpe_50k.tiktoken"
END_ID = 1

Query = Callable[[SparkSession, str], DataFrame]


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def _with_code(query: Query) -> Query:
    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_code(spark)
        return query(spark, sf_dir)

    return run


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judged(documents(spark, sf_dir)).select("doc_id", "quality.*")
    return judged.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
        "n_lines",
        "n_lines_removed",
    )


#: A document with a licence line and fewer words than this counts as a licence file.
LICENCE_FILE_WORDS = 120


def licence_paths(docs: DataFrame) -> DataFrame:
    """``docs`` with a ``path``: by source, then thousands and hundreds of the doc_id.
    The table has no paths of its own. Short documents that state a licence are named
    as licence files, so that they speak for their directory."""
    short = (word_count(F.col("text")) < LICENCE_FILE_WORDS) & F.col("text").rlike(
        license_scan.MENTION
    )
    folder = F.concat_ws(
        "/",
        F.coalesce("source", F.lit("unknown")),
        F.floor(F.col("doc_id") / 1000).cast("string"),
        F.floor(F.col("doc_id") / 100).cast("string"),
    )
    name = F.concat(F.when(short, F.lit("LICENSE.")).otherwise(F.lit("text-")), F.col("doc_id").cast("string"))
    # Every other licence file stands one directory higher, so that there is a depth to it.
    higher = F.regexp_replace(folder, "/[^/]*$", "")
    placed = F.when(short & (F.col("doc_id") % 2 == 0), higher).otherwise(folder)
    return docs.withColumn("path", F.concat_ws("/", placed, name))


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.licensed(licence_paths(documents(spark, sf_dir)))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digests(documents(spark, sf_dir))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicate_groups(documents(spark, sf_dir))


def held_out() -> Column:
    """Every fifth document by the checksum of its key; nothing is learned from these."""
    return F.crc32(F.col("doc_id").cast("string")) % 5 == 0


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = language.fit(docs, ~F.coalesce(held_out(), F.lit(True)))
    found = language.predicted(docs, model)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).drop("source")


#: Repeats of so many words are told, also those too short to be removed.
REPEATED_WORDS = 50


def op7_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_free.without_repeats(documents(spark, sf_dir), words=REPEATED_WORDS)


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(documents(spark, sf_dir), vocabulary())


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.duplicate_groups(documents(spark, sf_dir))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.written_documents(documents(spark, sf_dir), vocabulary(), END_ID)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_runs.digests(documents(spark, sf_dir))


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path(RANKS)
    return byte_bpe.round_trip(documents(spark, sf_dir), path, public_tokenizers.PATTERN)


QUERIES: dict[str, Query] = {
    f.__name__: _with_code(f)
    for f in (
        op1_quality_rules,
        op2_licenses,
        op3_secrets,
        op4_simhash,
        op5_language,
        op6_mixing,
        op7_repeats,
        op8_bpe,
        op9_exact_dedup,
        op10_token_files,
        op11_whitening,
        op12_periodic_runs,
        op13_byte_bpe,
    )
}

_IN_DUCKDB = {
    "word": WORD,
    "symbols": quality.SYMBOLS,
    "mark": f"^{quality.NAVIGATION_MARK}\\z",
    "boilerplate": quality.BOILERPLATE,
    "shouted": f"{quality.SHOUTED_WORD}\\z",
    "end": quality.END_MARK,
    "kept": quality.SHORT_BUT_KEPT,
}


def _quality_sql() -> str:
    p = {k: "'" + v.replace("'", "''") + "'" for k, v in _IN_DUCKDB.items()}
    like = "len(list_filter(ws, lambda w: regexp_matches(w, {})))".format
    return f"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), {p["word"]}) AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, {p["word"]})) AS ls
  FROM documents
), places AS (
  SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS p FROM d
), windows AS (
  SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, ws[p], ws[p + 1], ws[p + 2]) AS times FROM places
), again AS (
  SELECT doc_id, p FROM windows WHERE times > 1
), repeated AS (
  SELECT doc_id, count(*) AS n
  FROM (SELECT DISTINCT doc_id, p + k AS word FROM again, (VALUES (0), (1), (2)) x(k)) GROUP BY doc_id
), lines AS (
  SELECT doc_id, l, regexp_extract_all(l, {p["word"]}) AS ws FROM (SELECT doc_id, unnest(ls) AS l FROM d)
), passed AS (
  SELECT doc_id, count(*) AS n, sum(list_sum(list_transform(ws, lambda w: length(w)))) AS chars
  FROM lines
  WHERE NOT (
    ({like(p["mark"])} >= 2 AND {like(p["mark"])} * 4 >= len(ws))
    OR (len(ws) <= {quality.BOILERPLATE_MAX_WORDS} AND regexp_matches(l, {p["boilerplate"]}))
    OR {like(p["shouted"])} * 2 >= len(ws)
    OR len(regexp_extract_all(l, {p["symbols"]})) >= greatest(len(ws), {quality.SHORT_LINE_WORDS})
    OR (len(ws) < {quality.SHORT_LINE_WORDS} AND NOT regexp_matches(l, {p["end"]})
        AND NOT regexp_matches(l, {p["kept"]})))
  GROUP BY doc_id
), counted AS (
  SELECT d.doc_id, len(ws)::BIGINT AS n_words,
         coalesce(list_sum(list_transform(ws, lambda w: length(w))), 0)::BIGINT AS word_chars,
         len(regexp_extract_all(t, {p["symbols"]}))::BIGINT AS n_symbols,
         (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
         coalesce(r.n, 0)::BIGINT AS n_repeat_words,
         len(ls)::BIGINT AS n_lines, (len(ls) - coalesce(p.n, 0))::BIGINT AS n_lines_removed,
         coalesce(p.chars, 0) AS chars
  FROM d LEFT JOIN repeated r USING (doc_id) LEFT JOIN passed p USING (doc_id)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEATED_PERCENT} * n_words) AS base_failed,
       NOT (n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEATED_PERCENT} * n_words)
         AND 1 - chars / word_chars <= {quality.MAX_LOST} AS kept,
       n_lines, n_lines_removed
FROM counted
"""


ORACLE_SQL: dict[str, str] = {
    "op1_quality_rules": _quality_sql(),
    "op9_exact_dedup": """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
""",
}
