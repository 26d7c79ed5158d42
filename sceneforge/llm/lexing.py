"""Words of texts by column functions."""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import Column, functions as F


def ascii_lower(text: Column) -> Column:
    """``text`` with only A-Z lower-cased; null becomes an empty text.

    Texts of ASCII alone take Spark's own lower-casing, which does the same there and is faster.
    """
    text = F.coalesce(text, F.lit(""))
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def all_matches(text: Column, pattern: str) -> Column:
    """Matches of a pattern from left to right."""
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def places(count: Column) -> Column:
    """0, 1, ... below ``count``; empty when that is not positive."""
    return F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, also where ``body`` uses it for every element of an array.

    A column of an earlier step would not do: Spark puts a step into the next one where it is used once only,
    and then works it out again for each element.
    """
    return F.transform(F.array(value), body)[0]
