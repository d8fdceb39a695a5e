"""Secrets: fixed patterns, and candidate strings of high entropy.

Base kinds are regular expressions. Beyond them, strings of twenty or more characters
of one class (hexadecimal, letters and digits, base 64) are candidates: a window moves
over them, and its Shannon entropy is kept up to date by the counts of the two
characters that leave and enter, not computed anew. A candidate whose highest entropy
exceeds the threshold of its class is a secret unless the allow list suppresses it.

All of it is built-in expressions over one row; nothing moves. Spans are in code
points, end exclusive.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salestide.llm.tables import let

# The base kinds, in their order: pattern, the group whose length
# counts (0: the whole match), and the least length.
BASE = (
    (
        "assign",
        r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2,
        6,
    ),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    # Runs of hexadecimal digits never overlap, so shorter ones needn't be matched.
    ("hex", r"[0-9a-f]{24,}", 0, 24),
)

WINDOW = 20
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
# Character classes from narrow to wide: what the whole candidate consists of, and the
# entropy in bits a window of twenty must exceed (the most it can reach is 4.32).
CLASSES = (
    ("hex", r"^[0-9A-Fa-f]+\z", 3.0),
    ("alnum", r"^[A-Za-z0-9]+\z", 3.6),
    ("base64", r"^[A-Za-z0-9+/_=-]+\z", 3.7),
)
# What looks random and is not secret: words (letters only), numbers, identifiers with
# hyphens in groups, paths and words joined by marks, and placeholders.
ALLOWED = (
    r"^[A-Za-z]+\z",
    r"^[0-9]+\z",
    r"^[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}\z",
    r"^[A-Za-z0-9]{1,15}(?:[-_/+=]+[A-Za-z0-9]{1,15})+\z",
    r"(?i)example|placeholder|changeme|your_?key|xxxx|0123456789|abcdefgh",
)


def _pieces(text: Column, pattern: str) -> tuple[Column, Column]:
    """The matches in order, and the stretches of text before, between and after them."""
    return (
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
        F.split(text, pattern, -1),
    )


#: Arrays are put together in pieces of this many, so that none grows item by item.
PIECE = 256


def _running_piece(values: Column, start: Column, op: Callable[[Column, Column], Column]) -> Column:
    """``op`` of ``start`` and the values so far, for each of a few values."""
    first = F.struct(start.alias("at"), F.array().cast("array<int>").alias("out"))

    def step(state: Column, value: Column) -> Column:
        now = op(state["at"], value)
        return F.struct(now.alias("at"), F.concat(state["out"], F.array(now)).alias("out"))

    return F.aggregate(values, first, step, lambda state: state["out"])


def running(values: Column, op: Callable[[Column, Column], Column]) -> Column:
    """Running totals (or maxima, as ``op`` says) of an array of integers from 0 on.

    Piece by piece: the total of each piece, running totals of those, and inside each
    piece running totals from what came before. Copying what is there for each value
    would cost the square of their number."""
    def cut_up(whole: Column) -> Column:
        last = F.greatest(F.ceil(F.size(whole) / PIECE).cast("int") - 1, F.lit(0))
        return F.transform(F.sequence(F.lit(0), last), lambda k: F.slice(whole, k * PIECE + 1, PIECE))

    def inside(parts: Column) -> Column:
        totals = F.transform(parts, lambda p: F.aggregate(p, F.lit(0), op))
        upto = _running_piece(totals, F.lit(0), op)
        before = lambda k: F.when(k == 0, F.lit(0)).otherwise(F.get(upto, k - 1))
        return let(
            F.transform(parts, lambda p, k: F.struct(p.alias("p"), before(k).alias("b"))),
            lambda ps: F.flatten(F.transform(ps, lambda x: _running_piece(x["p"], x["b"], op))),
        )

    return let(let(values, cut_up), inside)


def spans_of(text: Column, pattern: str) -> Column:
    """Array of (s, e, m): start, end and text of each match, leftmost first."""
    matches, between = _pieces(text, pattern)

    def placed(found: Column, gaps: Column) -> Column:
        widths = F.transform(found, lambda m, i: F.length(F.get(gaps, i)) + F.length(m))
        return let(
            running(widths, lambda a, b: a + b),
            lambda ends: F.transform(
                found,
                lambda m, i: F.struct(
                    (F.get(ends, i) - F.length(m)).alias("s"), F.get(ends, i).alias("e"), m.alias("m")
                ),
            ),
        )

    none = F.from_json(F.lit("[]"), "array<struct<s:int,e:int,m:string>>")
    # Most texts have no match; for them neither array is built.
    return F.when(
        text.rlike(pattern), let(matches, lambda f: let(between, lambda g: placed(f, g)))
    ).otherwise(none)


def _kind(spans: Column, name: str) -> Column:
    return F.transform(
        spans, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.lit(name).alias("kind"))
    )


def base_spans(text: Column, name: str, pattern: str, group: int, least: int) -> Column:
    def long_enough(x: Column) -> Column:
        value = F.regexp_extract(x["m"], pattern, group) if group else x["m"]
        return F.length(value) >= least

    return _kind(F.filter(spans_of(text, pattern), long_enough), name)


#: The characters of candidates, and how their counts are packed: five bits for each,
#: twelve to a long.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
COUNT_BITS, COUNTS_IN_LONG = 5, 12


def peak_entropy(value: Column, window: int = WINDOW) -> Column:
    """Highest entropy, in bits for each character, of the windows of ``value``.

    With c the count of a character in the window, the entropy is
    log2(w) - sum(c log2 c) / w. The counts of all characters go along with the window:
    moving on by one takes one from the count of the character that leaves, adds one to
    that of the one that enters, and changes their two terms of the sum. ``value``
    consists of characters of ``ALPHABET``; the window is shorter than 32.
    """

    def term(c: Column) -> Column:
        return F.when(c > 1, c * F.log2(c.cast("double"))).otherwise(F.lit(0.0))

    def one(code: Column) -> Column:
        return F.pow(F.lit(2.0), COUNT_BITS * (code % COUNTS_IN_LONG)).cast("long")

    def changed(counts: Column, code: Column, sign: int) -> Column:
        place = F.floor(code / COUNTS_IN_LONG)
        return F.transform(counts, lambda w, k: F.when(k == place, w + sign * one(code)).otherwise(w))

    def count(counts: Column, code: Column) -> Column:
        packed = F.get(counts, F.floor(code / COUNTS_IN_LONG).cast("int"))
        return F.floor(packed / one(code)) % (1 << COUNT_BITS)

    def moved(codes: Column) -> Column:
        def enter(state: Column, code: Column) -> Column:
            c = count(state["counts"], code)
            total = state["sum"] - term(c) + term(c + 1)
            return F.struct(changed(state["counts"], code, 1).alias("counts"), total.alias("sum"))

        def step(state: Column, i: Column) -> Column:
            leaving = F.get(codes, i - 1)
            gone = changed(state["counts"], leaving, -1)
            c = count(state["counts"], leaving)
            rest = F.struct(gone.alias("counts"), (state["sum"] - term(c) + term(c - 1)).alias("sum"))
            return let(rest, lambda r: let(enter(r, F.get(codes, i + window - 1)), lambda n: F.struct(
                n["counts"].alias("counts"), n["sum"].alias("sum"), F.least(state["least"], n["sum"]).alias("least")
            )))

        empty = F.array_repeat(F.lit(0).cast("long"), -(-len(ALPHABET) // COUNTS_IN_LONG))
        start = F.aggregate(
            F.slice(codes, 1, window), F.struct(empty.alias("counts"), F.lit(0.0).alias("sum")), enter
        )
        moves = F.when(
            F.size(codes) > window, F.sequence(F.lit(1), F.size(codes) - window)
        ).otherwise(F.array().cast("array<int>"))
        return let(start, lambda s: F.aggregate(
            moves,
            F.struct(s["counts"].alias("counts"), s["sum"].alias("sum"), s["sum"].alias("least")),
            step,
            lambda state: state["least"],
        ))

    characters = F.filter(F.split(value, ""), lambda ch: ch != "")
    codes = F.transform(characters, lambda ch: F.instr(F.lit(ALPHABET), ch) - 1)
    return F.log2(F.lit(float(window))) - let(codes, moved) / window


def entropy_spans(text: Column) -> Column:
    """Candidates of high entropy that the allow list doesn't suppress."""

    def is_secret(x: Column) -> Column:
        value = x["m"]
        allowed = F.lit(False)
        for pattern in ALLOWED:
            allowed = allowed | value.rlike(pattern)
        threshold = F.coalesce(*[F.when(value.rlike(p), F.lit(t)) for _, p, t in CLASSES])
        # `when` keeps the walk over the windows away from allowed candidates.
        return F.when(allowed, F.lit(False)).otherwise(peak_entropy(value) > threshold)

    return _kind(F.filter(spans_of(text, CANDIDATE), is_secret), "entropy")


def _shown(spans: Column) -> Column:
    return F.array_join(
        F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))),
        ",",
    )


def scanned(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the struct column ``secrets`` added (one of that name is replaced).

    ``assign``, ``access``, ``hex``, ``entropy``: arrays of (s, e, kind) in order. The
    entropy spans leave out what a base span covers whole. ``base`` and ``all`` hold
    the spans by start, then by kind in that order. A null text counts as empty and
    has none. Rows are independent of each other.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    kinds = [name for name, *_ in BASE]
    found = docs.select(
        *[c for c in docs.columns if c != "secrets"],
        F.struct(
            *[base_spans(whole, *kind).alias(kind[0]) for kind in BASE],
            entropy_spans(whole).alias("entropy"),
        ).alias("secrets"),
    )

    s = F.col("secrets")
    rank = {name: k for k, name in enumerate([*kinds, "entropy"])}

    def ranked(name: str) -> Column:
        return F.transform(
            s[name],
            lambda x: F.struct(x["s"].alias("s"), F.lit(rank[name]).alias("r"), x["e"].alias("e"), x["kind"].alias("kind")),
        )

    def split(every: Column) -> Column:
        """An entropy span is covered if a base span that begins no later ends no sooner."""
        def kept(reach: Column) -> Column:
            return F.filter(every, lambda x, i: (x["r"] < len(kinds)) | (F.get(reach, i) < x["e"]))

        ends = F.transform(every, lambda x: F.when(x["r"] < len(kinds), x["e"]).otherwise(0))
        return let(running(ends, lambda a, b: F.greatest(a, b)), kept)

    def plain(spans: Column) -> Column:
        return F.transform(
            spans, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["kind"].alias("kind"))
        )

    def parts(every: Column) -> Column:
        return F.struct(
            *[s[k].alias(k) for k in kinds],
            plain(F.filter(every, lambda x: x["r"] == len(kinds))).alias("entropy"),
            plain(F.filter(every, lambda x: x["r"] < len(kinds))).alias("base"),
            plain(every).alias("all"),
        )

    every = F.array_sort(F.concat(*[ranked(k) for k in rank]))
    return found.withColumn("secrets", let(let(every, split), parts))


def digests(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts by kind, ``base_sha256`` over the base spans and ``spans`` with all."""
    s = F.col("secrets")
    return scanned(docs, text).select(
        key,
        *[F.size(s[k]).cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex", "entropy")],
        F.sha2(_shown(s["base"]), 256).alias("base_sha256"),
        _shown(s["all"]).alias("spans"),
    )
