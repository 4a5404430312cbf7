"""Column helpers for text."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import wraps

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def bound(function: Callable[[Column], Column]) -> Callable[[Column], Column]:
    """A function of one column whose argument is computed once."""

    @wraps(function)
    def call(value: Column) -> Column:
        return let(value, function)

    return call


def has(text: Column, pattern: str) -> Column:
    return text.rlike(pattern)


def any_of(text: Column, found: Sequence[str]) -> Column:
    """Whether one of several patterns matches."""
    out = F.lit(False)
    for pattern in found:
        out = out | text.rlike(pattern)
    return out


def first(text: Column, pattern: str, group: int = 1) -> Column:
    """A group of the first match; null where nothing matches."""
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, group))


def every(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def strip(text: Column) -> Column:
    """Without white space, Unicode's included, at either end."""
    return F.regexp_replace(text, P.U + r"^\s+|\s+$", "")


def trim_of(text: Column, characters: str) -> Column:
    return F.btrim(text, F.lit(characters))


def words(text: Column) -> Column:
    return F.filter(F.split(text, P.U + r"\s+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words(text))


def starts_upper(text: Column) -> Column:
    return text.rlike(r"(?U)^\p{Lu}")


def starts_lower(text: Column) -> Column:
    return text.rlike(r"(?U)^\p{Ll}")


def within(text: Column, values: Sequence[str]) -> Column:
    return text.isin(list(values))


def one_space(text: Column) -> Column:
    return strip(F.regexp_replace(text, P.U + r"\s+", " "))


def pairs(text: Column, pattern: str, *groups: int) -> Column:
    """Groups of every match, side by side: structs ``g1, g2, ...``."""
    return F.arrays_zip(*(every(text, pattern, g).alias(f"g{g}") for g in groups))


def distinct_in_order(values: Column) -> Column:
    return F.array_distinct(values)


def share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))
