"""The pipeline's stages against plain Python, and the queries' contract columns."""

from __future__ import annotations

from collections import defaultdict

import corpus_pipeline
from salestide.llm import quality
from salestide.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


def by_id(frame):
    out = defaultdict(list)
    for r in frame.collect():
        out[r["doc_id"]].append(r)
    return out


def test_stages(spark, sample):
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert len(names) == 5 and "simhash near-dedup" in names
    stages = [f for _, f in corpus_pipeline.STAGES]

    clean = stages[0](spark, sample, FOLDER).cache()
    assert clean.columns == sample.columns
    verdicts = {r["doc_id"]: r["quality"] for r in quality.judged(sample).collect()}
    assert set(by_id(clean)) == {k for k, q in verdicts.items() if q["kept"]}
    for key, (r,) in by_id(clean).items():
        assert r["text"] == verdicts[key]["clean_text"] and r["n_chars"] == len(r["text"])

    different = stages[1](spark, clean, FOLDER).cache()
    last_of = defaultdict(int)
    for r in clean.collect():
        last_of[r["text"]] = max(last_of[r["text"]], r["doc_id"])
    assert sorted(r["doc_id"] for r in different.collect()) == sorted(last_of.values())

    apart = stages[2](spark, different, FOLDER).cache()
    assert apart.columns == sample.columns and apart.count() <= different.count()

    mixed = stages[3](spark, apart, FOLDER).cache()
    assert mixed.columns == sample.columns
    assert set(by_id(mixed)) <= set(by_id(apart)) and max(map(len, by_id(mixed).values())) <= 2

    tokens = by_id(stages[4](spark, mixed, FOLDER))
    assert {k: len(v) for k, v in tokens.items()} == {k: len(v) for k, v in by_id(mixed).items()}
    whole = by_id(corpus_pipeline.run(spark, FOLDER))
    assert {k: sorted(r["ids_sha256"] for r in v) for k, v in whole.items()} == {
        k: sorted(r["ids_sha256"] for r in v) for k, v in tokens.items()
    }


CONTRACTS = {
    "op1_": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    "op2_": "doc_id licence",
    "op3_": "doc_id n_assign n_access n_hex base_sha256 spans",
    "op4_": "doc_id fingerprint component_id",
    "op5_": "doc_id held_out lang_pred score",
    "op6_": "doc_id size source_size target taken",
    "op7_": "doc_id n_bytes n_removed n_spans kept_sha256",
    "op8_": "doc_id n_tokens ids_sha256 decoded_sha256",
    "op9_": "doc_id keep_id group_size kept text_sha256",
    "op10_": "doc_id start n_tokens ids_crc32",
}


def test_queries_return_their_columns_for_every_document(spark, sample):
    expected = sample.count()
    for prefix, columns in CONTRACTS.items():
        (name,) = [n for n in QUERIES if n.startswith(prefix)]
        found = QUERIES[name](spark, FOLDER)
        assert set(columns.split()) <= set(found.columns), name
        assert found.count() == expected == found.select("doc_id").distinct().count(), name
