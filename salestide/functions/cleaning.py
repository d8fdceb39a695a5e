"""Tolerant parsing of text columns: bad text becomes null, never an error. The one
exception is a number too large for its column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Texts read as a missing value.
NA_TOKENS = (
    "",
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "None",
    "n/a",
    "nan",
    "null",
)

# Wide enough to see the decimals that a money column rounds away.
_AS_WRITTEN = T.DecimalType(38, 18)
_NUMBER = r"^\s*[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?\s*\z"


def na_to_null(text: Column, tokens: Sequence[str] = NA_TOKENS) -> Column:
    """The test is a lambda, which Spark keeps out of a stage's one generated method:
    the making of all texts and their parsing in one method are too long for the JVM
    to compile."""
    if not tokens:
        return text
    return F.when(F.forall(F.array(text), lambda t: ~t.isin(*tokens)), text)


def all_na_to_null(texts: Sequence[Column], tokens: Sequence[str] = NA_TOKENS) -> list[Column]:
    """``na_to_null`` of each text, to be taken in one projection. One lambda keeps all of
    it out of the stage's one generated method, where it is generated as many short ones;
    the other texts are tested without the lambda's detour over an array."""
    if not tokens:
        return list(texts)
    return [na_to_null(text, tokens) if n == 0 else F.when(~text.isin(*tokens), text) for n, text in enumerate(texts)]


def as_written(text: Column) -> Column:
    """Number as written, null when the text is not a number."""
    return text.try_cast(_AS_WRITTEN)


def parse_amount(text: Column, kind: T.DecimalType) -> Column:
    """Decimal of the given type, rounded half up; null when unparseable or
    out of range."""
    return text.try_cast(kind)


def is_too_large(text: Column, parsed: Column) -> Column:
    """A number was written, and its column cannot hold it."""
    return F.coalesce(parsed.isNull() & text.rlike(_NUMBER), F.lit(False))


def or_too_large(text: Column, kind: T.DecimalType, name: str) -> Column:
    """The parsed amount; a number that its type cannot hold is an error that names
    the column, as a null there would take revenue away without a word."""
    parsed = parse_amount(text, kind)
    message = F.concat(F.lit(f"{name} has a number that does not fit {kind.simpleString()}: "), text)
    return F.when(is_too_large(text, parsed), F.raise_error(message).cast(kind)).otherwise(parsed)


def is_unreadable(text: Column, parsed: Column) -> Column:
    """Something was written, and it could not be read."""
    return text.isNotNull() & parsed.isNull()


def is_rounded(text: Column, parsed: Column, kind: T.DecimalType | None = None) -> Column:
    """The parsed amount differs from what was written. Plain digits with no more decimals
    than the column never do; only other texts are read a second time."""
    scale = kind.scale if kind else 0
    as_is = text.rlike(rf"^[0-9]{{1,15}}+(?:\.[0-9]{{0,{scale}}})?+\z")
    return F.when(as_is, False).otherwise(F.coalesce(as_written(text) != parsed, F.lit(False)))
