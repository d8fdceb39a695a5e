"""Language by the nearest of several centroids.

A text becomes a vector of character n-grams (one to three lower-case letters, with one
space for whatever stands between words, folded into a fixed number of bins), weighted by TF-IDF and scaled to length one.
For each language the vectors of a bounded sample of its documents are clustered into
a few centroids, by spherical k-means with a fixed start. A text gets the language of
the centroid with the largest cosine; if that is further away than nearly all of the
centroid's own sample was, the answer is marked as rejected.

Document frequencies come from all training rows. What is broadcast has a fixed size:
one weight for each bin, and a few centroids for each language.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from salestide.llm.tables import saved

BINS = 1 << 13
NGRAMS = (1, 2, 3)
#: Bound of the sample that the centroids are fitted on: rows for each language.
SAMPLE_PER_LANGUAGE = 300
MAX_LANGUAGES = 500
CENTROIDS = 3
ROUNDS = 12
#: Share of a centroid's sample that lies within its rejection distance.
WITHIN = 0.995
SLACK = 0.15
UNKNOWN = "und"
CHARS_AT_ONCE = 1 << 20
TEXTS_AT_ONCE = 256


@dataclass(frozen=True)
class Model:
    """idf: (BINS,). centroids: (n, BINS), rows of length one. radius: smallest cosine
    that is not rejected. languages: the language of each centroid."""

    idf: np.ndarray
    centroids: np.ndarray
    radius: np.ndarray
    languages: list[str]


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For each code point, is it a letter?"""
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def _spelled(text: str | None) -> np.ndarray:
    """Lower-case letters, one space for all that stands between letters or around them."""
    points = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[points]
    after_letter = np.concatenate([[False], letter[:-1]])
    kept = np.where(letter, points, np.uint32(32))[letter | after_letter]
    return np.concatenate([np.array([32], np.uint32), kept])


def counts(text: str | None) -> np.ndarray:
    """How often each bin occurs among the n-grams of the whole text. Texts are taken
    in stretches that overlap by two characters, so no n-gram is lost or doubled."""
    out = np.zeros(BINS, np.int64)
    letters = _spelled(text)
    if len(letters) < 2:
        return out
    multiplier = np.uint64(0x9E3779B97F4A7C15)
    for size in NGRAMS:
        for at in range(0, len(letters) - size + 1, CHARS_AT_ONCE):
            part = letters[at : at + CHARS_AT_ONCE + size - 1].astype(np.uint64)
            n = len(part) - size + 1
            gram = np.full(n, size, np.uint64)
            for k in range(size):
                gram = (gram << np.uint64(21)) ^ part[k : k + n]
            bins = (gram * multiplier) >> np.uint64(64 - 13)
            out += np.bincount(bins.astype(np.int64), minlength=BINS)
    return out


def vectors(tallies: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """TF-IDF rows of length one; a row without n-grams stays zero."""
    weighted = np.sqrt(tallies, dtype=np.float32) * idf.astype(np.float32)
    length = np.linalg.norm(weighted, axis=1, keepdims=True)
    return weighted / np.maximum(length, 1e-12)


def clustered(rows: np.ndarray, k: int = CENTROIDS, rounds: int = ROUNDS) -> np.ndarray:
    """Spherical k-means. Starts from the row nearest the mean, then the rows furthest
    from those chosen; ties go to the first row."""
    chosen = [int(np.argmax(rows @ rows.mean(axis=0)))]
    while len(chosen) < min(k, len(rows)):
        nearest = (rows @ rows[chosen].T).max(axis=1)
        nearest[chosen] = np.inf
        chosen.append(int(np.argmin(nearest)))
    centres = rows[chosen]
    for _ in range(rounds):
        owner = np.argmax(rows @ centres.T, axis=1)
        sums = np.stack(
            [rows[owner == c].sum(axis=0) if (owner == c).any() else centres[c] for c in range(len(centres))]
        )
        centres = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return centres


def _document_frequencies(training: DataFrame, text: str) -> tuple[np.ndarray, int]:
    """Over all training rows; one partial count for each task meets in the sum."""

    def tally(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen, n = np.zeros(BINS, np.int64), 0
        for batch in batches:
            for value in batch["_text"]:
                seen += counts(value) > 0
                n += 1
        yield pd.DataFrame({"bin": np.arange(-1, BINS), "n": np.concatenate([[n], seen])})

    parts = training.select(F.col(text).alias("_text")).mapInPandas(tally, "bin int, n long")
    rows = parts.groupBy("bin").agg(F.sum("n").alias("n")).collect()  # BINS + 1 rows at most
    found = dict((r["bin"], r["n"]) for r in rows)
    return np.array([found.get(b, 0) for b in range(BINS)], np.float64), found.get(-1, 0)


def fit(
    docs: DataFrame,
    training: Column,
    key: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    per_language: int = SAMPLE_PER_LANGUAGE,
    max_languages: int = MAX_LANGUAGES,
) -> Model:
    """Learns from the rows where ``training`` holds, their language isn't null and
    their text has letters. The sample is, for each language, the ``per_language``
    rows with the smallest hashes of their keys; equal keys are taken in any order. Only
    the ``max_languages`` values with the most rows are learned (ties: those that sort
    first), so that a column full of junk cannot outgrow the driver."""
    usable = docs.where(training & F.col(lang).isNotNull() & F.col(text).isNotNull())
    frequency, n = _document_frequencies(usable, text)
    idf = np.log((1 + n) / (1 + frequency)) + 1

    plain = usable.select(F.col(f"`{lang}`").alias("_lang"), F.col(f"`{key}`").alias("_key"), F.col(f"`{text}`").alias("_text"))
    # At most max_languages * per_language keys are broadcast.
    common = plain.groupBy("_lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "_lang").limit(max_languages)
    ids = (
        plain.select("_lang", "_key")
        .join(F.broadcast(common.select("_lang")), "_lang", "left_semi")
        .withColumn("_hash", F.xxhash64("_key"))
        .withColumn("_nth", F.row_number().over(Window.partitionBy("_lang").orderBy("_hash", "_key")))
        .where(F.col("_nth") <= per_language)
        .select(F.col("_lang").alias("_l"), F.col("_key").alias("_k"), "_nth")
    )
    sample = plain.join(
        F.broadcast(ids), F.col("_key").eqNullSafe(F.col("_k")) & (F.col("_lang") == F.col("_l"))
    ).select("_lang", "_nth", "_text")

    def cluster(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows[rows["_text"].map(has_letter)].sort_values("_nth")
        if rows.empty:
            return pd.DataFrame({"lang": [], "centroid": [], "radius": []})
        points = vectors(np.stack([counts(t) for t in rows["_text"]]), idf)
        centres = clustered(points)
        cosine = points @ centres.T
        owner = np.argmax(cosine, axis=1)
        out = []
        for c, centre in enumerate(centres):
            own = cosine[owner == c, c]
            radius = float(np.quantile(own, 1 - WITHIN)) - SLACK if len(own) else 1.0
            out.append((rows["_lang"].iloc[0], centre.astype(float).tolist(), max(0.0, radius)))
        return pd.DataFrame(out, columns=["lang", "centroid", "radius"])

    kind = "lang string, centroid array<float>, radius double"
    fitted = saved(sample.groupBy("_lang").applyInPandas(cluster, kind), "language-centroids")
    rows = sorted(fitted.collect(), key=lambda r: (r["lang"], r["centroid"]))
    return Model(
        idf,
        np.array([r["centroid"] for r in rows], np.float32).reshape(len(rows), BINS),
        np.array([r["radius"] for r in rows]),
        [r["lang"] for r in rows],
    )


def predicted(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``lang_pred``, ``score`` (cosine with the nearest centroid, 0 to 1) and
    ``rejected`` (it is outside that centroid's distance) for each row of ``docs``.

    A text that is null or has no letter gets ``und``, 0 and rejected; so does every
    text if nothing was learned. Equal cosines go to the language that sorts first.
    Only the text is looked at, so repeated rows get equal answers. An empty table
    gives no rows.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = held.value
        for batch in batches:
            texts = batch["_text"].tolist()
            names, scores, rejected = [], [], []
            for at in range(0, len(texts), TEXTS_AT_ONCE):
                part = texts[at : at + TEXTS_AT_ONCE]
                if not m.languages:
                    names += [UNKNOWN] * len(part)
                    scores += [0.0] * len(part)
                    rejected += [True] * len(part)
                    continue
                cosine = vectors(np.stack([counts(t) for t in part]), m.idf) @ m.centroids.T
                best = np.argmax(cosine, axis=1)
                top = np.clip(cosine[np.arange(len(part)), best], 0.0, 1.0).astype(float)
                for value, b, score in zip(part, best.tolist(), top.tolist()):
                    known = has_letter(value)
                    names.append(m.languages[b] if known else UNKNOWN)
                    scores.append(score if known else 0.0)
                    rejected.append(not known or score < m.radius[b])
            yield pd.DataFrame(
                {key: batch[key].to_numpy(), "lang_pred": names, "score": scores, "rejected": rejected}
            )

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, F.col(text).alias("_text")).mapInPandas(
        predict, f"`{key}` {kind}, lang_pred string, score double, rejected boolean"
    )
