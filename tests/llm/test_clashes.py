"""Columns named like the operators' own: rows and columns come back as they were."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from salestide.llm import exact_dedup, language, mixing, quality, secret_scan, simhash

NAMES = [
    "quality", "_q", "_seen", "_one", "_own", "_sha", "_own_sha", "_times", "_copy", "_key", "_text", "_lang", "_keep",
    "_mark", "_split", "secrets", "fp", "size", "target", "taken", "name", "_rank", "n", "root", "a", "b", "_hash", "_nth",
]


@pytest.fixture(scope="module")
def plain(spark):
    rng = random.Random(2)
    words = ["stone", "river", "light", "under", "green", "seven", "about", "never", "house", "water"]
    rows = []
    for i in range(40):
        lines = [" ".join(rng.choice(words) + rng.choice("abcdefgh") for _ in range(12)) + "." for _ in range(8)]
        rows.append((i, "\n".join(lines), rng.choice(["en", "de"]), rng.choice(["x", "y", None]), 0))
    rows += [(100, rows[0][1], "en", "x", 0), (101, rows[1][1] + " end.", "en", "x", 0), (102, None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").cache()


@pytest.fixture(scope="module")
def clashing(plain):
    return plain.select("*", *[F.lit(f"own {c}").alias(c) for c in NAMES]).cache()


def keyed(frame, columns):
    return sorted(map(str, frame.select(*columns).collect()))


def stages(spark):
    return [(name, lambda d, f=stage: f(spark, d, "")) for name, stage in corpus_pipeline.STAGES]


def test_stages_and_public_functions(spark, plain, clashing):
    ways = [
        *stages(spark)[:4],
        ("cleaned", quality.cleaned),
        ("without_duplicates", exact_dedup.without_duplicates),
        ("one_of_each", simhash.one_of_each),
        ("mixed_rows", mixing.mixed_rows),
    ]
    for name, way in ways:
        odd = way(clashing)
        assert odd.columns == clashing.columns, name
        assert keyed(odd, plain.columns) == keyed(way(plain), plain.columns), name
        assert odd.where(" AND ".join(f"`{c}` = 'own {c}'" for c in NAMES)).count() == odd.count(), name


def test_last_stage_and_reports(spark, plain, clashing):
    for way in (
        stages(spark)[4][1],
        secret_scan.digests,
        exact_dedup.duplicate_groups,
        simhash.near_duplicate_groups,
        mixing.mix,
        lambda d: language.predicted(d, language.fit(d, F.lit(True))).select("doc_id", "lang_pred"),
    ):
        odd, want = way(clashing), way(plain)
        assert odd.columns == want.columns and keyed(odd, want.columns) == keyed(want, want.columns)


def test_scanned_keeps_a_users_columns(clashing):
    out = secret_scan.scanned(clashing)
    assert set(out.columns) == set(clashing.columns) and out.where("_split = 'own _split'").count() == clashing.count()


def test_of_a_key_with_several_texts_each_is_judged_alone(spark):
    one, two = "alpha beta gamma delta", "completely other words stand here now"
    rows = spark.createDataFrame([(5, one), (5, two), (3, two), (9, one), (None, "x y z")], "doc_id long, text string")
    assert {tuple(r) for r in simhash.one_of_each(rows).collect()} == {(5, one), (3, two), (None, "x y z")}


def test_links_of_a_crowd_are_told_once(spark):
    """Fingerprints that share a crowded key beside ones that are compared in pairs."""
    rng = random.Random(4)
    base = rng.getrandbits(60)
    crowd = {base} | {base ^ (1 << b) for b in range(40)} | {rng.getrandbits(60) for _ in range(20)}
    found = simhash.links(spark.createDataFrame([(f,) for f in crowd], "fp long")).collect()
    assert len(found) == len({tuple(r) for r in found})
    assert all(bin(r.a ^ r.b).count("1") <= 4 for r in found)
