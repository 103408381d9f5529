"""Strict reading of JSON text with built-in functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What counts as a finite number written as text. A Java cast alone would also take "0.5d" or "NaN".
NUMBER = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"


def strict_object(text: Column, fields: str) -> Column:
    """The named top-level fields of text if it is exactly one complete JSON object, else null.

    Wrapping the text in an array makes anything after the object (junk, a second object) or a
    missing end an error, which from_json on the bare text would let pass. Bare NaN and Infinity
    are allowed, single quotes are not. Null and empty text give null.
    """
    def parse(t: Column) -> Column:
        rows = F.from_json(F.concat(F.lit("["), t, F.lit("]")), f"array<struct<{fields}>>", {"allowSingleQuotes": "false"})
        return F.when(t.startswith("{") & t.endswith("}"), rows)

    # lambdas bind their argument, so that the text is trimmed and parsed once
    trimmed = F.array(F.trim(text, F.lit(" \t\r\n")))
    return F.transform(F.transform(trimmed, parse), lambda r: F.when(F.size(r) == 1, r[0]))[0]


def finite_number(text: Column) -> Column:
    """text as a finite double, null where it is none (null, NaN, infinite, other words)."""
    # lambdas bind their argument, so that what text is made of runs once
    read = lambda t: F.when(t.rlike(NUMBER), t.try_cast("double"))
    finite = lambda x: F.when(F.abs(x) < float("inf"), x)
    return F.transform(F.transform(F.array(text), read), finite)[0]
