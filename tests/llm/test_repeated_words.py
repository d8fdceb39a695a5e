"""Repeats of 50 words, also those under 400 bytes, against a brute-force version."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np

from salestide.llm import prefix_free, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def repeated_words(source, length=50):
    said = [(key, WORD.findall(text or "")) for key, text in source]
    seen = Counter(tuple(w[i : i + length]) for _, w in said for i in range(len(w) - length + 1))
    out = []
    for key, w in said:
        told = np.zeros(len(w), bool)
        for i in range(len(w) - length + 1):
            if seen[tuple(w[i : i + length])] > 1:
                told[i : i + length] = True
        out.append((key, int(told.sum())))
    return Counter(out)


def passages():
    rng = np.random.default_rng(5)

    def noise(n, kinds=500):
        return [f"w{x}" for x in rng.integers(0, kinds, n)]

    shared, long, few = noise(55), noise(400), noise(300, 2)
    said = [
        noise(60) + shared + noise(20),  # the same words, other whitespace, under 400 bytes
        shared + noise(5),
        noise(10) + shared[:49] + noise(10),  # one word short
        noise(7) + shared[5:],
        noise(30) + long + noise(30),
        noise(3) + long[:180] + noise(2) + long[182:] + noise(9),
        long[100:170] + noise(1) + long[100:150],
        few,
        noise(4) + few[20:200] + noise(4),
        ["ab"] * 130,
        ["ab"] * 49,
        ["ab", "ü"] * 40,
        noise(40) + ["ab", "ü"] * 26,
        noise(80),
    ]
    rows = [(i, " ".join(w)) for i, w in enumerate(said)]
    rows[3] = (3, "\n\t" + "\r\n ".join(said[3]) + "\x0b")
    # Copies: of 60 short words, of 49, and of none.
    short = ["x"] * 3 + [f"{x}" for x in range(57)]
    rows += [(20, " ".join(short)), (21, " ".join(short)), (22, " ".join(short[:49])), (23, " ".join(short[:49]))]
    return rows + [(30, None), (31, ""), (32, " \n"), (33, " ".join(short))]


def test_repeated_words(spark):
    frame = spark.createDataFrame(passages(), "doc_id long, text string")
    expected = repeated_words(passages())
    assert {n for _, n in expected} > {0, 50, 55, 60}
    plain = Counter(tuple(r) for r in prefix_free.without_repeats(frame).collect())
    found = prefix_free.without_repeats(frame, words=50).collect()
    assert Counter((r["doc_id"], r["n_repeated_words"]) for r in found) == expected
    # What is removed stays as it is.
    assert Counter(tuple(r)[:-1] for r in found) == plain


def test_short_passages_are_told_and_stay(spark, tmp_path):
    rng = np.random.default_rng(6)
    shared, *others = ([f"w{x}" for x in rng.integers(0, 5000, n)] for n in (52, 40, 90, 70))
    texts = [" ".join(others[0] + shared), " ".join(shared + others[1]), " ".join(others[2]), None]
    assert len(" ".join(shared)) < prefix_free.LENGTH
    rows = [(i, t, "en", "web", len(t or "")) for i, t in enumerate(texts)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    found = {r["doc_id"]: r for r in queries.QUERIES["op7_repeats"](spark, str(tmp_path)).collect()}
    assert [found[i]["n_repeated_words"] for i in range(4)] == [52, 52, 0, 0]
    assert {r["n_removed"] for r in found.values()} == {0}
